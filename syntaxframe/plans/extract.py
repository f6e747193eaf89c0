"""Plans from node rows to typed rows, one for each mode. All are projections and filters: no joins, no shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import converted, unescaped
from ..model import AnyOf, Binding, Eq, Matches
from ..parse.rows import Wanted
from ..valuemap import ValueMap
from .analyze import Checked
from .paths import selected

FAILURE = "_failure"
_NODE = "array<struct<node_id int, text string>>"


def _stays() -> Column:
    """Always true. A condition that takes it in is not moved below the step that makes ``_here``; otherwise it is spelled out down to the nodes, each
    step written out at each of its uses: a thousand lambdas for two captures."""
    return F.col("_here") >= 0



def wanted(checked: Checked) -> Wanted:
    """What the parser must make for a model's plan."""
    values, spec = checked.values or ValueMap(), checked.spec
    wrappers = {k: (leaf,) for k, leaf in values.wrappers.items()}
    anchors = frozenset(spec.path.anchors)
    if spec.record:
        pairs = frozenset(k for c in _all(checked) for k in c.pair_kinds)
        leaves = {k: v for c in _all(checked) for k, v in c.key_leaves.items()}
        return Wanted(anchors, anchors if _meta_text(checked) else frozenset(), wrappers, pairs, leaves, bool(checked.nested), False)
    return Wanted(anchors, anchors if _meta_text(checked) else frozenset(), wrappers)


def _all(checked: Checked):
    yield checked
    for inner in checked.nested.values():
        yield from _all(inner)


def _meta_text(checked: Checked) -> bool:
    return any(b.targets == ("span",) for b in checked.spec.bindings)


def tests(b: Binding, text: Column) -> Column:
    """The predicates of a binding on a captured text."""
    out = F.lit(True)
    for p in b.predicates:
        if isinstance(p, Matches):
            out = out & text.rlike(p.regex)
        elif isinstance(p, Eq):
            out = out & (text == p.value)
        elif isinstance(p, AnyOf):
            out = out & text.isin(*p.values)
    return out


def place(b: Binding) -> Column:
    """source_meta: the anchor's line or span."""
    if b.targets != ("span",):
        return (F.col("start_row") + 1).cast("long")
    return F.struct(
        (F.col("start_row") + 1).alias("line"), F.col("start_col").alias("column"), (F.col("end_row") + 1).alias("end_line"),
        F.col("end_col").alias("end_column"), "start_byte", "end_byte", "text",
    )


def constant(b: Binding) -> Column:
    kind = b.spark_type()
    if not b.has_default or b.default is None:
        return F.lit(None).cast(kind)
    if isinstance(b.default, list):
        return F.array(*map(F.lit, b.default)).cast(kind)
    return F.lit(b.default).cast(kind)


def _given(cond: Column, text: str) -> Column:
    return F.when(cond, F.lit(text))


def valued(b: Binding, got: Column) -> tuple[Column, Column]:
    """A binding's value and what is wrong with it (null if nothing), from its captures (an array of node_id and text)."""
    decode = unescaped if b.unescape else (lambda t: t)
    convert = lambda t: converted(decode(t), b.targets)
    if b.is_list:
        value = F.transform(got, lambda c: convert(c["text"]))
        bad = F.exists(got, lambda c: convert(c["text"]).isNull())
        return value, _given(bad, f"{b.name}: an element is not {' or '.join(b.targets)}")
    ids = F.array_distinct(F.transform(got, lambda c: c["node_id"]))
    first = F.try_element_at(got, F.lit(1))["text"]
    return _scalar(b, F.size(got) > 0, (F.size(got) > 1) & (F.size(ids) > 1), first, convert(first))


def _scalar(b: Binding, some: Column, several: Column, first: Column, value: Column) -> tuple[Column, Column]:
    """A scalar's value and what is wrong with it: was there a capture, were there several, the text of the first, what it is as a value."""
    wrong = F.concat(F.lit(f"{b.name}: "), first, F.lit(f" is not {' or '.join(b.targets)}"))
    problem = (
        F.when(several, F.lit(f"{b.name}: ambiguous, several nodes were captured"))
        .when(some & value.isNull(), wrong)
        .when(~some & F.lit(b.required), F.lit(f"{b.name}: missing"))
    )
    return F.when(some, value).otherwise(constant(b)), problem


def failure(spec_name: str, problems: list[Column], here: bool = False) -> Column:
    """A struct that says why a row failed, or null."""
    errors = F.filter(F.array(*problems), lambda p: p.isNotNull()) if problems else F.array().cast("array<string>")
    detail = F.struct(
        F.lit(spec_name).alias("pattern"), F.col("kind").alias("anchor"), "node_id", (F.col("start_row") + 1).alias("line"), F.col("start_col").alias("column"),
        "start_byte", "end_byte", errors.alias("errors"),
    )
    if not problems:
        return F.when(F.lit(False), detail)
    wrong = F.coalesce(*problems).isNotNull()
    return F.when(wrong & _stays() if here else wrong, detail)


# Field mode.


def _candidates(b: Binding, checked: Checked) -> Column:
    """Captures that a child could be: (idx, nodes) for each child that fits."""
    kinds = checked.kinds.get(b.name, b.kinds)
    wraps = (checked.values.wrappers if checked.values else {}) if not b.unescape else {}

    def fits(c: Column) -> Column:
        at = (c["field"] == b.key) if b.source == "field" else (c["kind"] == b.key)
        test = at & c["named"]
        return test & c["kind"].isin(*kinds) if kinds else test

    # A wrapper's text is its inner leaf, if the pattern names the wrapper.
    named = set(kinds) | ({b.key} if b.source == "kind" else set())

    def nodes(c: Column) -> Column:
        whole = F.array(F.struct(c["node_id"].alias("node_id"), c["text"].alias("text")))
        inner = sorted(named & set(wraps)) if "str" in b.targets else []
        found = F.when(c["kind"].isin(*inner), c["inner"]).otherwise(whole) if inner else whole
        return F.filter(found, lambda n: tests(b, n["text"])) if b.predicates else found

    found = F.transform(F.filter("children", fits), lambda c: F.struct(c["idx"].alias("idx"), nodes(c).alias("nodes")))
    return F.filter(found, lambda c: F.size(c["nodes"]) > 0)


def field_rows(nodes: DataFrame, checked: Checked, carried: list[str]) -> DataFrame:
    """Rows of a field-mode model, with ``_failure``.

    Required scalar captures are taken in the order of declaration: each needs a child of its own after the one before.
    A capture that could be several children is ambiguous. An anchor without a required child gives no row.
    """
    spec = checked.spec
    out = nodes.where(selected(spec.path))
    names = {b.name: f"_c{i}" for i, b in enumerate(spec.captures)}
    out = out.withColumns({**{names[b.name]: _candidates(b, checked) for b in spec.captures}, "_here": F.spark_partition_id()}) if spec.captures else out
    chain = [b for b in spec.captures if b.required]
    low: dict[str, str] = {}
    before: Column = F.lit(-1)
    for b in chain:
        low[b.name] = f"_l{names[b.name]}"
        out = out.withColumn(low[b.name], F.array_min(_after(names[b.name], before)))
        out = out.where(F.col(low[b.name]).isNotNull() & _stays())
        before = F.col(low[b.name])
    high: dict[str, str] = {}
    after: Column = F.lit(1 << 30)
    for b in reversed(chain):
        high[b.name] = f"_h{names[b.name]}"
        out = out.withColumn(high[b.name], F.array_max(_before(names[b.name], after)))
        after = F.col(high[b.name])
    got: dict[str, Column] = {}
    for i, b in enumerate(spec.captures):
        held = F.col(names[b.name])
        if b.required:
            held = F.filter(held, lambda c: c["idx"].between(F.col(low[b.name]), F.col(high[b.name])))
        elif not b.is_list:
            up = [low[o.name] for o in spec.captures[:i] if o.required]
            down = [high[o.name] for o in spec.captures[i + 1 :] if o.required]
            if up:
                held = F.filter(held, lambda c: c["idx"] > F.col(up[-1]))
            if down:
                held = F.filter(held, lambda c: c["idx"] < F.col(down[0]))
            # Optional captures of one field take what those before them left.
            for other in (o for o in spec.captures[:i] if o.source == b.source and o.key == b.key and not o.is_list and not o.required):
                held = F.slice(held, 2, 1 << 30)
        got[b.name] = F.flatten(F.transform(held, lambda c: c["nodes"])).cast(_NODE)
    return _finished(out, checked, got, {}, carried)


def captured_rows(rows: DataFrame, checked: Checked, carried: list[str]) -> DataFrame:
    """field_rows() from the rows of plans.captured. Texts are converted in a step of their own, which stays below what asks for the values."""
    spec, made, scalars = checked.spec, {"_here": F.spark_partition_id()}, {}
    for i, b in enumerate(spec.captures):
        text, n = F.col(f"_t{i}"), F.col(f"_n{i}")
        made[f"_v{i}"] = converted(unescaped(text) if b.unescape else text, b.targets)
        scalars[b.name] = _scalar(b, n > 0, n > 1, text, F.col(f"_v{i}"))
    return _finished(rows.withColumns(made), checked, {}, scalars, carried, True)


def _after(name: str, bound: Column) -> Column:
    return F.transform(F.filter(name, lambda c: c["idx"] > bound), lambda c: c["idx"])


def _before(name: str, bound: Column) -> Column:
    return F.transform(F.filter(name, lambda c: c["idx"] < bound), lambda c: c["idx"])


def _finished(out: DataFrame, checked: Checked, got: dict[str, Column], structs: dict[str, tuple[Column, Column]], carried: list[str], here: bool = False) -> DataFrame:
    spec, columns, problems = checked.spec, [], []
    held = {name: f"_g_{name}" for name in got}
    out = out.withColumns({**{held[n]: c for n, c in got.items()}, "_here": F.spark_partition_id()}) if got else out
    for b in spec.bindings:
        if b.source == "meta":
            columns.append(place(b).alias(b.name))
        elif b.source == "derived":
            columns.append(constant(b).alias(b.name))
        elif b.name in structs:
            value, problem = structs[b.name]
            columns.append(value.cast(b.spark_type()).alias(b.name))
            problems.append(problem)
        else:
            value, problem = valued(b, F.col(held[b.name]))
            columns.append(value.cast(b.spark_type()).alias(b.name))
            problems.append(problem)
    # node_id stays: it is a row's place in document order.
    return out.select(*carried, "node_id", *columns, failure(spec.model.__name__, problems, here or bool(got)).alias(FAILURE))


# Record mode.


def _of_value(b: Binding, checked: Checked, p: Column) -> Column:
    """The captures of one pair's value."""
    kinds, values = checked.kinds.get(b.name, ()), checked.values
    none = F.array().cast(_NODE)
    whole = F.array(F.struct(p["value_id"].alias("node_id"), p["value_text"].alias("text")))
    if b.kinds:
        return F.when(p["value_kind"].isin(*b.kinds), whole).otherwise(none)
    wraps = [k for k in kinds if k in values.wrappers]
    plain = [k for k in kinds if k not in values.wrappers]

    def shape(kind: Column, own: Column, inner: Column) -> Column:
        out = F.when(kind.isin(*plain), own) if plain else None
        if wraps:
            taken = own if b.unescape else inner
            out = F.when(kind.isin(*wraps), taken) if out is None else out.when(kind.isin(*wraps), taken)
        return none if out is None else out.otherwise(none)

    if not b.is_list:
        return shape(p["value_kind"], whole, p["inner"])
    arrays = [k for k, items in values.arrays.items() if set(items) & set(kinds)]
    each = F.transform(p["items"], lambda i: shape(i["kind"], F.array(F.struct(i["node_id"].alias("node_id"), i["text"].alias("text"))), i["inner"]))
    return F.when(p["value_kind"].isin(*arrays), F.flatten(each)).otherwise(none)


def _record(checked: Checked, owner: Column, pairs: Column) -> tuple[dict[str, Column], dict[str, tuple[Column, Column]], Column]:
    """Captures of a record's bindings, its nested records with their problems, and whether it stays."""
    got, structs, stays = {}, {}, F.lit(True)
    for b in checked.spec.captures:
        mine = F.filter(pairs, lambda p: (p["owner"] == owner) & (p["key"] == b.key) & p["kind"].isin(*checked.pair_kinds))
        if b.nested is not None:
            structs[b.name] = _nested(b, checked.nested[b.name], mine, pairs)
            continue
        found = F.flatten(F.transform(mine, lambda p: _of_value(b, checked, p)))
        if b.predicates:
            found = F.filter(found, lambda n: tests(b, n["text"]))
            if b.required:
                stays = stays & (F.size(found) > 0)
        got[b.name] = found.cast(_NODE)
    return got, structs, stays


def _nested(b: Binding, inner: Checked, mine: Column, pairs: Column) -> tuple[Column, Column]:
    """A nested record (or, for a list, one for each element of an array) and what is wrong with it."""

    def built(owner: Column) -> Column:
        got, structs, stays = _record(inner, owner, pairs)
        parts, problems = [], []
        for c in inner.spec.bindings:
            if c.source in ("meta", "derived"):
                parts.append(constant(c).alias(c.name))
                continue
            value, problem = structs[c.name] if c.name in structs else valued(c, got[c.name])
            parts.append(value.cast(c.spark_type()).alias(c.name))
            problems.append(problem)
        wrong = F.array_join(F.filter(F.array(*problems), lambda p: p.isNotNull()), "; ") if problems else F.lit("")
        return F.struct(F.struct(*parts).alias("row"), wrong.alias("wrong"), stays.alias("stays"))

    if b.is_list:
        owners = F.flatten(F.transform(mine, lambda p: F.transform(p["items"], lambda i: i["node_id"])))
    else:
        owners = F.transform(F.filter(mine, lambda p: p["value_named"]), lambda p: p["value_id"])
    rows = F.filter(F.transform(owners, built), lambda r: r["stays"])
    wrong = F.filter(F.transform(rows, lambda r: r["wrong"]), lambda w: w != "")
    problem = F.when(F.size(wrong) > 0, F.concat(F.lit(f"{b.name}: "), F.array_join(wrong, "; ")))
    if b.is_list:
        return F.transform(rows, lambda r: r["row"]).cast(b.spark_type()), problem
    problem = problem.when((F.size(rows) == 0) & F.lit(b.required), F.lit(f"{b.name}: missing"))
    return F.try_element_at(rows, F.lit(1))["row"].cast(b.spark_type()), problem


def record_rows(nodes: DataFrame, checked: Checked, carried: list[str]) -> DataFrame:
    """Rows of a record-mode model, with ``_failure``: keys in any order, one row a record."""
    out = nodes.where(selected(checked.spec.path))
    got, structs, stays = _record(checked, F.col("node_id"), F.col("pairs"))
    return _finished(out.where(stays), checked, got, structs, carried)


def raw_rows(matches: DataFrame, checked: Checked, carried: list[str]) -> DataFrame:
    """Rows of a raw query: one for each match. ``matches`` has captures: map of name to array of nodes."""
    got = {}
    for b in checked.spec.captures:
        names = [n for n in dict.fromkeys((b.key, b.name)) if n is not None]
        held = F.coalesce(*(F.try_element_at("captures", F.lit(n)) for n in names), F.array().cast(_NODE))
        got[b.name] = (F.filter(held, lambda n: tests(b, n["text"])) if b.predicates else held).cast(_NODE)
    return _finished(matches, checked, got, {}, carried)
