"""Queries to DataFrames: clause by clause, one declarative plan.

MATCH adds joins of edge and node tables, starting from the most selective
node of a pattern; conditions on one node are applied at its scan, pattern
predicates become semi and anti joins, all else is left to Catalyst.  Only
long variable-length ranges and shortest paths run as loops.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import refuse
from ..functions.expr import Expressions, entity_struct
from ..functions.props import Prop
from ..operators.hydrate import whole_paths
from ..operators.shortest import shortest_paths
from ..operators.trails import trails
from . import ast as A
from .counting import Counting
from .parser import parse
from .strict import check_strict
from .symbols import Frame, Symbol
from .tree import conjuncts, has_aggregate, names_in, walk


def keyed(items) -> tuple[A.Item, ...]:
    """Items under names of their own."""
    return tuple(A.Item(item.value, f"_r{i}") for i, item in enumerate(items))


def turned_about(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` with the values of two columns exchanged."""
    return df.select(*(F.col({a: b, b: a}.get(c, c)).alias(c) for c in df.columns))


def wanted_ids(name: str | None, parts: list) -> list[int] | None:
    """The ids that a conjunct ``id(name) = n`` or ``id(name) IN [...]`` leaves, None if there is none."""
    for part in parts:
        if not (name and isinstance(part, A.Binary) and part.op in ("=", "in")):
            continue
        sides = [(part.left, part.right)] + ([(part.right, part.left)] if part.op == "=" else [])
        for call, other in sides:
            if isinstance(call, A.Call) and call.name == "id" and call.args == (A.Variable(name),):
                items = other.items if part.op == "in" and isinstance(other, A.ListLiteral) else (other,) if part.op == "=" else ()
                values = [x.value for x in items if isinstance(x, A.Literal) and isinstance(x.value, int) and not isinstance(x.value, bool)]
                if items and len(values) == len(items):
                    return values
    return None


class Compiler:
    def __init__(self, graph, parameters: dict, shortest: str | None, strict: bool) -> None:
        self.graph, self.parameters, self.shortest, self.strict = graph, parameters, shortest, strict
        self.counter = 0
        #: Names whose kinds are looked at after they are bound.
        self.kind_names: set[str] = set()
        #: Properties that each name needs anywhere; '*' for whole entities.
        self.needed: dict[str, set[str]] = defaultdict(set)

    def fresh(self, stem: str) -> str:
        self.counter += 1
        return f"{stem}{self.counter}"

    # The whole query.
    def run(self, query: A.Query) -> DataFrame:
        self.note_needs(query)
        frame, out = Frame(), None
        counted = self.counting(query)
        for clause in query.clauses if counted is None else query.clauses[-1:]:
            if isinstance(clause, A.Match):
                frame = self.optional(frame, clause) if clause.optional else self.match(frame, clause)
            elif isinstance(clause, A.Unwind):
                frame = self.unwind(frame, clause)
            elif clause.final:
                out = self.finish(frame, clause, counted)
            else:
                frame = self.carry(frame, clause)
        if out is None:
            raise refuse("a query without RETURN")
        if query.union:
            other = compiled(self.graph, query.union[0], self.parameters, self.strict, self.shortest)
            out = out.unionByName(other)
            out = out if query.union[1] else out.distinct()
        return out

    def counting(self, query: A.Query) -> Counting | None:
        """The matches as counts, if the query asks for nothing else."""
        *matches, last = query.clauses
        if self.graph.budget is not None or not matches or any(not isinstance(c, A.Match) or c.optional for c in matches) or not isinstance(last, A.Project) or last.star:
            return None
        counted = Counting(self, matches, keyed(last.items))
        return counted if counted.fits else None

    def note_needs(self, query: A.Query) -> None:
        alias: dict[str, set[str]] = defaultdict(set)
        for clause in query.clauses:
            for x in walk(clause):
                if isinstance(x, A.Property) and isinstance(x.owner, A.Variable):
                    self.needed[x.owner.name].add(x.name)
                if isinstance(x, (A.NodePattern, A.EdgePattern)) and x.name:
                    self.needed[x.name].update(k for k, _ in x.props)
            if isinstance(clause, A.Project):
                for item in clause.items:
                    if isinstance(item.value, A.Variable):
                        if clause.final:
                            self.needed[item.value.name].add("*")
                        elif item.alias and item.alias != item.value.name:
                            alias[item.value.name].add(item.alias)
        for name, others in alias.items():
            for other in others:
                self.needed[name] |= self.needed[other]

    def props_of(self, name: str | None, extra: set[str], edge: bool = False) -> list[str]:
        wanted = set(extra) | (self.needed.get(name, set()) if name else set())
        if "*" in wanted:
            wanted = (wanted - {"*"}) | set(self.graph.prop_names(edge) if not self.graph.json else ())
        return sorted(wanted)

    # MATCH.
    def match(self, frame: Frame, clause: A.Match) -> Frame:
        parts = conjuncts(clause.where)
        used: set[int] = set()
        pending = list(clause.patterns)
        while pending:
            # Patterns that touch what is bound come first.
            pattern = next((p for p in pending if any(x.name in frame.symbols for x in p.parts if x.name)), pending[0])
            pending.remove(pattern)
            frame = self.search(frame, pattern, parts, used) if pattern.search else self.expand(frame, pattern, parts, used)
        for i, part in enumerate(parts):
            if i not in used:
                frame = self.filtered(frame, part)
        return frame

    def scan(self, pattern: A.NodePattern, name: str, parts: list, used: set[int]) -> tuple[DataFrame, Symbol]:
        """Nodes of a pattern with its conditions applied, under fresh column names."""
        props = self.props_of(pattern.name, {k for k, _ in pattern.props})
        stem = self.fresh("n")
        df = self.graph.nodes(pattern.kinds, tuple(props), wanted_ids(pattern.name, parts))
        renamed = {"id": f"{stem}_id", "kinds": f"{stem}_kinds"} | {f"p_{i}": f"{stem}_p{i}" for i in range(len(props))}
        df = df.select(*(F.col(a).alias(b) for a, b in renamed.items()))
        symbol = Symbol("node", {"id": f"{stem}_id", "kinds": f"{stem}_kinds"}, {p: f"{stem}_p{i}" for i, p in enumerate(props)})
        own = Frame(df, {name: symbol})
        for key, value in pattern.props:
            own = self.filtered(own, A.Binary("=", A.Property(A.Variable(name), key), value))
        for i, part in enumerate(parts):
            if i not in used and pattern.name and names_in(part) == {pattern.name} and not any(isinstance(x, A.Exists) for x in walk(part)):
                own = self.filtered(own, part)
                used.add(i)
        return own.df, symbol

    def rank(self, pattern: A.NodePattern, parts: list) -> int:
        """How selective a node of a pattern is: id, equality, other condition, kinds, none."""
        own = [p for p in parts if pattern.name and names_in(p) == {pattern.name}]
        for p in own:
            if isinstance(p, A.Binary) and p.op == "=" and any(isinstance(x, A.Call) and x.name == "id" for x in (p.left, p.right)):
                return 0
        if pattern.props or any(isinstance(p, A.Binary) and p.op in ("=", "in") for p in own):
            return 1
        return 2 if own else 3 if pattern.kinds else 4

    def expand(self, frame: Frame, pattern: A.Pattern, parts: list, used: set[int]) -> Frame:
        nodes, edges = pattern.parts[::2], pattern.parts[1::2]
        names = [n.name or self.fresh("_n") for n in nodes]
        edge_names = [e.name or self.fresh("_e") for e in edges]
        bound = [i for i, n in enumerate(names) if n in frame.symbols]
        start = bound[0] if bound else min(range(len(nodes)), key=lambda i: self.rank(nodes[i], parts))
        frame = Frame(frame.df, dict(frame.symbols))
        if not bound:
            df, symbol = self.scan(nodes[start], names[start], parts, used)
            self.guard_product(frame, df, names[start], parts)
            frame.df = df if frame.df is None else frame.df.crossJoin(df)
            frame.symbols[names[start]] = symbol
        else:
            frame = self.narrowed(frame, names[start], nodes[start])
        walked: list[int] = []
        for i in [*range(start, len(edges)), *range(start - 1, -1, -1)]:
            forward = i >= start
            here, there = (i, i + 1) if forward else (i + 1, i)
            frame = self.step(frame, (names[here], names[there]), nodes[there], edges[i], edge_names[i], forward, parts, used)
            frame = self.unlike(frame, [(edges[j], edge_names[j]) for j in walked], edges[i], edge_names[i])
            walked.append(i)
        if pattern.name:
            frame = self.path(frame, pattern.name, names, edges, edge_names)
        return frame

    def narrowed(self, frame: Frame, name: str, pattern: A.NodePattern) -> Frame:
        """A bound node met again: its kinds and properties become conditions."""
        if pattern.kinds:
            frame = self.filtered(frame, A.HasKinds(A.Variable(name), pattern.kinds))
        for key, value in pattern.props:
            frame = self.filtered(frame, A.Binary("=", A.Property(A.Variable(name), key), value))
        return frame

    def edge_rows(self, edge: A.EdgePattern, name: str) -> tuple[DataFrame, Symbol]:
        props = self.props_of(edge.name, {k for k, _ in edge.props}, True)
        stem = self.fresh("e")
        df = self.graph.edges(edge.kinds, tuple(props))
        renamed = {c: f"{stem}_{c}" for c in ("id", "src", "dst", "kind")} | {f"p_{i}": f"{stem}_p{i}" for i in range(len(props))}
        df = df.select(*(F.col(a).alias(b) for a, b in renamed.items()))
        symbol = Symbol("edge", {c: f"{stem}_{c}" for c in ("id", "src", "dst", "kind")}, {p: f"{stem}_p{i}" for i, p in enumerate(props)})
        own = Frame(df, {name: symbol})
        for key, value in edge.props:
            own = self.filtered(own, A.Binary("=", A.Property(A.Variable(name), key), value))
        return own.df, symbol

    def step(self, frame: Frame, ends: tuple[str, str], far: A.NodePattern, edge: A.EdgePattern, edge_name: str, forward: bool, parts: list, used: set[int]) -> Frame:
        here, there = ends
        direction = edge.direction if forward else {"out": "in", "in": "out", "both": "both"}[edge.direction]
        known = frame.bound(there)
        symbols = dict(frame.symbols)
        if edge_name in symbols:
            raise refuse(f"edge {edge_name} is bound twice")
        if edge.hops is None:
            df, symbol = self.edge_rows(edge, edge_name)
            near, end = (symbol.columns["src"], symbol.columns["dst"]) if direction != "in" else (symbol.columns["dst"], symbol.columns["src"])
            if direction == "both":
                # Either way; a loop doesn't bind two names.
                turned = turned_about(df, near, end)
                df = df.where(F.col(near) != F.col(end)).unionByName(turned.where(F.col(near) != F.col(end)))
        else:
            if edge.props:
                raise refuse("properties of a variable-length edge")
            seeds = frame.df.select(frame.symbols[here].col("id").alias("id")).distinct()
            stem = self.fresh("t")
            ends, far_nodes = None, None
            if known is not None:
                ends = frame.df.select(known.col("id").alias("id"))
            elif self.far_matters(far, parts, used):
                far_nodes = self.scan(far, there, parts, used)
                ends = far_nodes[0].select(far_nodes[1].col("id").alias("id"))
            df = trails(self.graph.edges(edge.kinds), seeds, direction, *edge.hops, ends=ends, budget=self.graph.budget)
            near, end = f"{stem}_start", f"{stem}_end"
            turn = (lambda c: F.col(c)) if forward else F.reverse
            df = df.select(F.col("t_start").alias(near), F.col("t_end").alias(end), turn("t_edges").alias(f"{stem}_edges"), turn("t_nodes").alias(f"{stem}_nodes"))
            symbol = Symbol("trail", {"edges": f"{stem}_edges", "nodes": f"{stem}_nodes"})
        symbols[edge_name] = symbol
        condition = frame.symbols[here].col("id") == F.col(near)
        if known is not None:
            joined = frame.df.join(df, condition & (known.col("id") == F.col(end)))
            out = Frame(joined, symbols)
            return self.narrowed(out, there, far)
        joined = frame.df.join(df, condition)
        far_nodes = far_nodes if edge.hops is not None else self.scan(far, there, parts, used) if self.far_matters(far, parts, used) else None
        if far_nodes is not None:
            nodes, node_symbol = far_nodes
            symbols[there] = node_symbol
            return Frame(joined.join(nodes, F.col(end) == node_symbol.col("id")), symbols)
        # Edges end at existing nodes: the far table adds nothing but its id.
        stem = self.fresh("n")
        symbols[there] = Symbol("node", {"id": f"{stem}_id"})
        return Frame(joined.withColumn(f"{stem}_id", F.col(end)), symbols)

    def guard_product(self, frame: Frame, df: DataFrame, name: str, parts: list) -> None:
        """With a budget, refuse a product of unconnected patterns that is larger; an equality makes it a join."""
        joined = any(isinstance(p, A.Binary) and p.op == "=" and name in names_in(p) and names_in(p) & set(frame.symbols) for p in parts)
        if self.graph.budget is not None and frame.df is not None and not joined and frame.df.count() * df.count() > self.graph.budget:
            raise refuse(f"a product of more than {self.graph.budget} rows", "budget")

    def far_matters(self, far: A.NodePattern, parts: list, used: set[int]) -> bool:
        """Whether the far node of a step adds more than its id."""
        conditions = any(i not in used and far.name and names_in(p) == {far.name} for i, p in enumerate(parts))
        return bool(far.kinds or conditions or self.props_of(far.name, {k for k, _ in far.props}) or far.name in self.kind_names)

    def unlike(self, frame: Frame, earlier: list, edge: A.EdgePattern, name: str) -> Frame:
        """No edge twice in a pattern; two variable-length parts may share edges."""
        symbol = frame.symbols[name]
        for other, other_name in earlier:
            if other.kinds and edge.kinds and not set(other.kinds) & set(edge.kinds):
                continue
            before = frame.symbols[other_name]
            if symbol.kind == "edge" and before.kind == "edge":
                frame.df = frame.df.where(symbol.col("id") != before.col("id"))
            elif symbol.kind != before.kind:
                one, many = (symbol, before) if symbol.kind == "edge" else (before, symbol)
                frame.df = frame.df.where(~F.array_contains(many.col("edges"), one.col("id")))
        return frame

    def path(self, frame: Frame, name: str, names: list[str], edges: tuple, edge_names: list[str]) -> Frame:
        """Nodes and edges of a pattern in written order."""
        nodes, ids = [F.array(frame.symbols[names[0]].col("id"))], [F.array().cast("array<bigint>")]
        for far, edge_name in zip(names[1:], edge_names, strict=True):
            symbol = frame.symbols[edge_name]
            if symbol.kind == "edge":
                nodes.append(F.array(frame.symbols[far].col("id")))
                ids.append(F.array(symbol.col("id")))
            else:
                nodes.append(F.slice(symbol.col("nodes"), 2, F.size(symbol.col("nodes"))))
                ids.append(symbol.col("edges"))
        stem = self.fresh("q")
        df = frame.df.withColumns({f"{stem}_nodes": F.concat(*nodes), f"{stem}_edges": F.concat(*ids)})
        return Frame(df, frame.symbols | {name: Symbol("path", {"nodes": f"{stem}_nodes", "edges": f"{stem}_edges"})})

    def search(self, frame: Frame, pattern: A.Pattern, parts: list, used: set[int]) -> Frame:
        """shortestPath and allShortestPaths between two nodes."""
        if len(pattern.parts) != 3 or pattern.parts[1].hops is None or pattern.parts[1].hops[0] > 1:
            raise refuse("a shortest path of this shape")
        left, edge, right = pattern.parts
        names = [n.name or self.fresh("_n") for n in (left, right)]
        selective = [n in frame.symbols or self.rank(p, parts) < 3 for n, p in zip(names, (left, right), strict=True)]
        mode = "one" if pattern.search == "one" else self.shortest or ("overall" if not any(selective) else "pair")
        if pattern.search == "all" and not self.shortest and self.strict and any(selective) != all(selective):
            raise refuse("which shortest paths", "shortest_semantics")
        symbols, tables = dict(frame.symbols), []
        for name, node in zip(names, (left, right), strict=True):
            if name in symbols:
                tables.append(frame.df.select(symbols[name].col("id").alias("id")))
            else:
                df, symbol = self.scan(node, name, parts, used)
                symbols[name] = symbol
                tables.append((df, symbol))
        ids = [t if isinstance(t, DataFrame) else t[0].select(t[1].col("id").alias("id")) for t in tables]
        apart = any(isinstance(p, A.Binary) and p.op == "<>" and names_in(p) == set(names) for p in parts)
        if self.strict and not apart and not ids[0].join(ids[1], "id").isEmpty():
            raise refuse("both ends may be one node", "self_endpoint")
        found = shortest_paths(self.graph.edges(edge.kinds), ids[0], ids[1], edge.direction, edge.hops[1], mode, self.graph.budget)
        stem = self.fresh("t")
        found = found.select(*(F.col(f"t_{c}").alias(f"{stem}_{c}") for c in ("start", "end", "edges", "nodes")))
        df = frame.df
        on = {0: F.col(f"{stem}_start"), 1: F.col(f"{stem}_end")}
        joins = [symbols[n].col("id") == on[i] for i, n in enumerate(names) if isinstance(tables[i], DataFrame)]
        df = found if df is None else df.join(found, joins[0] if len(joins) == 1 else joins[0] & joins[1]) if joins else df.crossJoin(found)
        for i, (name, table) in enumerate(zip(names, tables, strict=True)):
            if not isinstance(table, DataFrame):
                df = df.join(table[0], symbols[name].col("id") == on[i])
        path = Symbol("path", {"nodes": f"{stem}_nodes", "edges": f"{stem}_edges"})
        symbols[pattern.name or self.fresh("_p")] = path
        symbols[edge.name or self.fresh("_e")] = Symbol("trail", {"edges": f"{stem}_edges", "nodes": f"{stem}_nodes"})
        return Frame(df, symbols)

    # Conditions.
    def filtered(self, frame: Frame, part) -> Frame:
        """Rows that a conjunct holds for."""
        negated = isinstance(part, A.Unary) and part.op == "not"
        inner = part.value if negated else part
        if isinstance(inner, A.Exists):
            condition, relation = self.exists(frame, inner)
            return Frame(frame.df.join(relation, condition, "left_anti" if negated else "left_semi"), frame.symbols)
        if isinstance(inner, A.Binary) and inner.op == "in" and isinstance(inner.right, A.Variable):
            symbol = frame.bound(inner.right.name)
            if symbol is not None and symbol.relation is not None:
                ids = symbol.relation
                value = self.expressions(frame).value(inner.left).col
                return Frame(frame.df.join(ids, value == ids["member"], "left_anti" if negated else "left_semi"), frame.symbols)
        holder = Frame(frame.df, frame.symbols)
        nested: list[str] = []

        def marker(node: A.Exists):
            # A pattern predicate inside OR: a join that marks rows instead of dropping them.
            condition, relation = self.exists(holder, node)
            name = self.fresh("m")
            holder.df = holder.df.join(relation.withColumn(name, F.lit(True)), condition, "left")
            nested.append(name)
            return F.col(name).isNotNull()

        condition = Expressions(self.graph, holder, self.parameters, marker).condition(part)
        df = holder.df.where(condition)
        return Frame(df.drop(*nested) if nested else df, frame.symbols)

    def exists(self, frame: Frame, node: A.Exists):
        """(join condition, distinct keys) of a one-hop pattern predicate."""
        parts = node.pattern.parts
        if len(parts) != 3 or parts[1].hops is not None:
            raise refuse("a pattern predicate of more than one fixed hop")
        left, edge, right = parts
        if edge.name:
            raise refuse("a named edge in a pattern predicate")
        df, symbol = self.edge_rows(edge, "_x")
        a, b = symbol.columns["src"], symbol.columns["dst"]
        if edge.direction == "in":
            a, b = b, a
        if edge.direction == "both":
            turned = turned_about(df, a, b)
            if left.kinds or right.kinds:
                df, turned = (x.where(F.col(a) != F.col(b)) for x in (df, turned))
            df = df.unionByName(turned)
        keys, condition = [], None
        for pattern, column in ((left, a), (right, b)):
            known = frame.bound(pattern.name)
            if known is not None:
                keys.append(column)
                same = known.col("id") == F.col(column)
                condition = same if condition is None else condition & same
            if pattern.kinds or pattern.props:
                nodes, own = self.scan(A.NodePattern(None, pattern.kinds, pattern.props), self.fresh("_n"), [], set())
                df = df.join(nodes, F.col(column) == own.col("id"), "left_semi")
        if not keys:
            raise refuse("a pattern predicate without a bound node")
        return condition, df.select(*keys).distinct()

    def expressions(self, frame: Frame) -> Expressions:
        return Expressions(self.graph, frame, self.parameters)

    def optional(self, frame: Frame, clause: A.Match) -> Frame:
        """A left join with the clause's matches, its condition inside the join."""
        shared = [n for n in sorted(names_in(clause)) if n in frame.symbols and frame.symbols[n].relation is None]
        if frame.df is None or not shared:
            raise refuse("OPTIONAL MATCH that shares nothing")
        columns = list(dict.fromkeys(c for n in shared for c in frame.symbols[n].all_columns()))
        keys = [c for n in shared for c in (frame.symbols[n].columns.get("id"), frame.symbols[n].columns.get("value")) if c]
        copies = {c: self.fresh("k") for c in columns}
        inner = Frame(frame.df.select(*(F.col(c).alias(k) for c, k in copies.items())).dropDuplicates([copies[k] for k in keys]), {})
        for n in shared:
            s = frame.symbols[n]
            inner.symbols[n] = Symbol(s.kind, {x: copies[c] for x, c in s.columns.items()}, {x: copies[c] for x, c in s.props.items()}, s.type)
        matched = self.match(inner, A.Match(clause.patterns, clause.where))
        new = {n: s for n, s in matched.symbols.items() if n not in frame.symbols}
        held = [c for s in new.values() for c in s.all_columns()]
        right = matched.df.select(*(copies[k] for k in keys), *dict.fromkeys(held))
        condition = None
        for k in keys:
            same = F.col(k) == F.col(copies[k])
            condition = same if condition is None else condition & same
        return Frame(frame.df.join(right, condition, "left"), frame.symbols | new)

    def unwind(self, frame: Frame, clause: A.Unwind) -> Frame:
        df = frame.df if frame.df is not None else self.graph.spark.range(1).select()
        value = self.expressions(frame).value(clause.value)
        stem = self.fresh("u")
        array = value.prop.elements() if value.prop else value.col
        kind = value.items[0].type if value.items else "text"
        df = df.withColumn(stem, F.explode(array))
        return Frame(df, frame.symbols | {clause.alias: Symbol("scalar", {"value": stem}, type=kind)})

    # WITH and RETURN.
    def carry(self, frame: Frame, clause: A.Project) -> Frame:
        frame = self.projected(frame, clause)
        if clause.distinct:
            frame = Frame(self.once(frame), frame.symbols)
        df = self.cut(frame, frame.df, clause)
        frame = Frame(df, frame.symbols)
        for part in conjuncts(clause.where):
            frame = self.filtered(frame, part)
        return frame

    @staticmethod
    def once(frame: Frame) -> DataFrame:
        return frame.trimmed().distinct()

    def cut(self, frame: Frame, df: DataFrame, clause: A.Project) -> DataFrame:
        """ORDER BY, SKIP and LIMIT."""
        if clause.order:
            keys = []
            for value, up in clause.order:
                made = self.expressions(frame).value(value)
                keys += self.sort_keys(made, up)
            df = df.orderBy(*keys)
        for value, skip in ((clause.skip, True), (clause.limit, False)):
            if value is None:
                continue
            n = self.expressions(Frame()).value(value).literal
            if not isinstance(n, int) or n < 0:
                raise refuse("SKIP and LIMIT take whole numbers")
            df = df.offset(n) if skip else df.limit(n)
        return df

    @staticmethod
    def sort_keys(value, up: bool) -> list:
        """JSON null before numbers before absent; descending is the exact reverse."""
        keys = []
        if value.prop and value.prop.json:
            c = value.col
            rank = F.when(c.isNull(), 2).when(c["t"] == "null", 0).otherwise(1)
            columns = [rank, c["num"], c["txt"]]
        else:
            columns = [value.plain()]
        for c in columns:
            keys.append(c.asc_nulls_last() if up else c.desc_nulls_first())
        return keys

    def items(self, frame: Frame, clause: A.Project) -> list[A.Item]:
        items = list(clause.items)
        if clause.star:
            names = [n for n, s in frame.symbols.items() if not n.startswith("_") and s.relation is None]
            items = [A.Item(A.Variable(n), n) for n in names] + items
        return items

    def projected(self, frame: Frame, clause: A.Project) -> Frame:
        """WITH's names; aggregates group by the other items."""
        items = self.items(frame, clause)
        symbols: dict[str, Symbol] = {}
        df = frame.df if frame.df is not None else self.graph.spark.range(1).select()
        groups, made, collected = [], {}, {}
        for item in items:
            name = item.alias or (item.value.name if isinstance(item.value, A.Variable) else None)
            if name is None:
                raise refuse("a WITH item without a name")
            if has_aggregate(item.value):
                if not isinstance(item.value, A.Call):
                    raise refuse("an expression over an aggregate in WITH")
                if item.value.name == "collect" and isinstance(item.value.args[0], A.Variable):
                    collected[name] = item.value
                else:
                    stem = self.fresh("g")
                    made[stem] = self.aggregate(frame, item.value)
                    symbols[name] = Symbol("scalar", {"value": stem}, type=made[stem][1])
                continue
            if isinstance(item.value, A.Variable) and item.value.name in frame.symbols:
                symbols[name] = frame.symbols[item.value.name]
                groups += symbols[name].all_columns()
                continue
            value = self.expressions(frame).value(item.value)
            stem = self.fresh("w")
            df = df.withColumn(stem, value.col)
            symbols[name] = Symbol("scalar", {"value": stem}, type=self.scalar_type(value))
            groups.append(stem)
        groups = list(dict.fromkeys(groups))
        if made or collected:
            source = df
            for name, call in collected.items():
                ids = self.expressions(frame).value(call.args[0]).col
                if groups:
                    stem = self.fresh("g")
                    made[stem] = (F.collect_set(ids), "list")
                    symbols[name] = Symbol("collected", {"value": stem})
                else:
                    # A set of the whole result stays a relation; membership becomes a semi or anti join.
                    symbols[name] = Symbol("collected", relation=source.select(ids.alias("member")).where("member is not null").distinct())
            grouped = df.groupBy(*groups)
            df = grouped.agg(*(c.alias(s) for s, (c, _) in made.items())) if made else df.select(*groups).distinct() if groups else None
        elif frame.df is None and not items:
            df = None
        return Frame(df, symbols)

    @staticmethod
    def scalar_type(value) -> str:
        return value.type if not (value.prop and not value.prop.json) else {"str": "text", "num": "float8", "bool": "bool", "arr": "list"}[value.prop.tag]

    def aggregate(self, frame: Frame, call: A.Call):
        """(column, value type) of an aggregate call."""
        if call.name == "count" and call.star:
            return F.count(F.lit(1)).cast("bigint"), "int8"
        if len(call.args) != 1:
            raise refuse(f"arguments of {call.name}")
        value = self.expressions(frame).value(call.args[0])
        if call.name == "count":
            col = value.key() if not value.prop or not value.prop.json else F.when(~value.prop.missing(), value.key())
            return (F.count_distinct(col) if call.distinct else F.count(col)).cast("bigint"), "int8"
        if call.name == "collect":
            col = value.plain()
            return (F.collect_set(col) if call.distinct else F.collect_list(col)), "list"
        number = value.prop.cast_to("double") if value.prop and value.prop.tag in ("any", "num") and call.name in ("sum", "avg") else value.plain()
        if call.distinct and call.name in ("sum", "avg"):
            return (F.sum_distinct(number) if call.name == "sum" else F.sum_distinct(number) / F.count_distinct(number)), "float8"
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[call.name](number), value.type if value.type != "prop" else "text" if call.name in ("min", "max") and value.prop.tag == "str" else "float8"

    def finish(self, frame: Frame, clause: A.Project, counted: Counting | None = None) -> DataFrame:
        """RETURN: names, groups, distinct rows, order and slice."""
        items = self.items(frame, clause)
        taken: set[str] = set()

        def title(item: A.Item) -> str:
            if item.alias:
                out = item.alias.lower()
                if out in taken:
                    raise refuse(f"two columns named {out}")
            else:
                v = item.value
                out = v.name if isinstance(v, A.Variable) else v.name if isinstance(v, A.Call) else "?column?"
                stem, n = out, 1
                while out in taken:
                    n += 1
                    out = f"{stem}_{n}"
            taken.add(out)
            return out

        titles = [title(i) for i in items]
        if any(has_aggregate(i.value) for i in items):
            frame = counted.frame() if counted else self.projected(frame, A.Project(keyed(items)))
            order = []
            for value, up in clause.order:
                at = next((i for i, item in enumerate(items) if item.value == value or isinstance(value, A.Variable) and item.alias == value.name), None)
                if at is None:
                    raise refuse("ORDER BY something that is not returned")
                order.append((A.Variable(f"_r{at}"), up))
            clause = A.Project(tuple(A.Item(A.Variable(f"_r{i}"), t) for i, t in enumerate(titles)), False, clause.distinct, tuple(order), clause.skip, clause.limit, None, True)
            items = list(clause.items)
        expressions = self.expressions(frame)
        df = frame.df if frame.df is not None else self.graph.spark.range(1).select()
        outputs, symbols = [], dict(frame.symbols)
        stems = []
        for item, name in zip(items, titles, strict=True):
            stem = self.fresh("o")
            value = expressions.value(item.value)
            if value.type in ("node", "edge") and isinstance(item.value, A.Variable):
                symbol = frame.symbols[item.value.name]
                column = entity_struct(symbol, self.props_of(item.value.name, set(), value.type == "edge"))
                df = df.withColumn(stem, column)
                symbols[item.alias or name] = symbol
            else:
                df = df.withColumn(stem, value.col if value.prop else value.plain())
                symbols[item.alias or name] = Symbol("scalar", {"value": stem}, type="prop" if value.prop and value.prop.json else value.type if not value.prop else {"str": "text", "num": "float8", "bool": "bool", "arr": "list"}[value.prop.tag])
            outputs.append((stem, name, value))
            stems.append(stem)
        if clause.distinct:
            carried = [c for s in symbols.values() for c in s.all_columns() if c in stems]
            for item in items:
                if isinstance(item.value, A.Variable) and item.value.name in frame.symbols:
                    carried += frame.symbols[item.value.name].all_columns()
            df = df.select(*dict.fromkeys([*stems, *carried])).distinct()
            symbols = {n: s for n, s in symbols.items() if set(s.all_columns()) <= set(df.columns)}
            # A sort key that is returned under another name is found by its column.
            clause = A.Project(clause.items, False, True, tuple((self.returned(v, items, titles), up) for v, up in clause.order), clause.skip, clause.limit, None, True)
        df = self.cut(Frame(df, symbols), df, clause)
        out = df.select(*((Prop(F.col(s), None).output() if v.prop and v.prop.json else F.col(s)).alias(n) for s, n, v in outputs))
        paths = [n for _, n, v in outputs if v.type == "path"]
        return whole_paths(self.graph, out, paths, bool(clause.order)) if paths else out

    @staticmethod
    def returned(value, items: list[A.Item], titles: list[str]):
        for item, name in zip(items, titles, strict=True):
            if item.value == value:
                return A.Variable(item.alias or name)
        return value


def compile_query(graph, text: str, parameters: dict, strict: bool, shortest: str | None) -> DataFrame:
    tree = parse(text)
    if strict:
        check_strict(tree, graph, parameters)
    return compiled(graph, tree, parameters, strict, shortest)


def compiled(graph, tree: A.Query, parameters: dict, strict: bool, shortest: str | None) -> DataFrame:
    compiler = Compiler(graph, parameters, shortest, strict)
    compiler.kind_names = {x.owner.name for c in tree.clauses for x in walk(c) if isinstance(x, A.HasKinds)}
    compiler.kind_names |= {a.name for c in tree.clauses for x in walk(c) if isinstance(x, A.Call) and x.name == "labels" for a in x.args if isinstance(a, A.Variable)}
    compiler.kind_names |= {i.value.name for c in tree.clauses if isinstance(c, A.Project) and c.final for i in c.items if isinstance(i.value, A.Variable)}
    # A name met again later with kinds of its own must carry its kinds.
    seen: set[str] = set()
    for x in (x for c in tree.clauses for x in walk(c) if isinstance(x, A.NodePattern)):
        if x.name in seen and x.kinds:
            compiler.kind_names.add(x.name)
        seen.add(x.name)
    return compiler.run(tree)
