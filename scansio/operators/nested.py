"""Deeply nested records as related flat tables, by Merkle identities of their objects.

Every object gets an identity from the bottom up: the hash of its kind, its own fields in canonical form, and the
identities of its children in order. Objects that hold the same have the same identity wherever they occur, so each is
stored once (`objects`), the children of each object are stored once (`bridge`: parent, field, ordinal, child), and
every occurrence is kept by the links from the roots (`roots`: record, field, ordinal, child). Ordinals count null
elements, which are links to no child. Joining roots to bridges gives back all occurrences, without the objects.
What a child holds stands in the child only: an object's content is its own fields.

Records are read and hashed once, in one pass over all deliveries, into a written table of nodes; roots, bridge and
objects are read from that. A record's own identity, over those of its parts, then tells its deliveries apart.

JSON text is read as it is meant: text that is JSON inside JSON is unwrapped as often as it was wrapped, `payload`
envelopes are opened, field names are taken in any case, numbers may be text (in any of the digits below) and a verse may
be given as two fields, a `ref` object or a `ref` text. Text that is no valid JSON holds nothing; an object that names a
field twice isn't valid. Objects of the data that have no table of their own are stored as parts under their name;
what is nested in these stays in their content.

Null and empty arrays hold no objects, an object whose fields are all null is an object, rows with a null id are left
out, and a record delivered again is one record; if its deliveries differ, the one of the greatest identity counts. All
of it is built-in expressions; rows are never gathered by record.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scansio.operators.dedup import one_per_id
from scansio.session import spread, written

#: Digits other than ASCII ones that numbers in texts are written with (Arabic-Indic, extended Arabic-Indic), as 0-9.
OTHER_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"


@dataclass(frozen=True)
class Store:
    """roots: `root_kind, root_id, field, ordinal, child_id`; bridge: `parent_id, field, ordinal, child_id, label`;
    objects: `object_id, kind, content, occurrences` (of all places that hold the object; only of a store with contents);
    linked: the links of each distinct node as arrays; children: the kinds of them."""

    roots: DataFrame
    bridge: DataFrame
    objects: DataFrame | None
    linked: DataFrame
    children: tuple[str, ...]


def identity(kind: str, own: Column, names: Sequence[str], *children: Column) -> Column:
    """128 bits of the hash over kind, own fields in their order and the identities of children (null elements count).
    Each field is written with its length before it, so that no two objects are written alike; a null has no length."""
    field = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    parts = [field(own[n].cast("string")) for n in names]
    return _hash(F.concat_ws("\n", F.lit(kind), *parts, *[_listed(c) for c in children]))


def _hash(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _listed(ids: Column) -> Column:
    """Identities in their order as one text."""
    return F.coalesce(F.array_join(F.transform(ids, lambda x: F.coalesce(F.hex(x), F.lit("-"))), ","), F.lit("none"))


# --- page layouts ---------------------------------------------------------------------------------------------------

WORD_FIELDS = ("location", "word", "qpc_v1")
LINE_FIELDS = ("line", "line_type", "text", "surah", "verse_range", "qpc_v1")


def _pick(o: Column, names: Sequence[str]) -> Column:
    return F.struct(*[o[n].alias(n) for n in names])


def _word(w: Column) -> Column:
    return F.when(w.isNotNull(), let(_pick(w, WORD_FIELDS), lambda own: F.struct(identity("word", own, WORD_FIELDS).alias("id"), own.alias("own"), F.coalesce(own["location"], F.lit("")).alias("label"))))


def _line(o: Column) -> Column:
    def held(words: Column) -> Column:
        own = _pick(o, LINE_FIELDS)
        return F.struct(identity("line", own, LINE_FIELDS, F.transform(words, lambda w: w["id"])).alias("id"), own.alias("own"), words.alias("word"))

    return F.when(o.isNotNull(), let(F.transform(o["words"], _word), held))


def layout_nodes(pages: DataFrame, contents: bool = True) -> DataFrame:
    """The written nodes of all places of `lines`, with their words."""
    return _nodes(pages, "page_id", "lines", _line, ("word",), contents)


# --- data of diagnostic events --------------------------------------------------------------------------------------


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def parsed(text: Column) -> Column:
    """The one JSON value that text holds; null if it is no valid JSON, or something follows the value."""
    return let(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant")))


def seen(o: Column) -> Column:
    """A JSON value with what is asked of it often: its fields as a map (null if it is no object), and whether any of
    their names isn't in small letters."""
    both = F.struct(o.alias("o"), F.try_variant_get(o, "$", "map<string,variant>").alias("m"))
    return let(both, lambda x: F.struct(x["o"].alias("o"), x["m"].alias("m"), F.exists(F.map_keys(x["m"]), lambda k: k != F.lower(k)).alias("odd")))


def _field(x: Column, name: str, kind: str) -> Column:
    """A field of a `seen` value, its name in any case; that in small letters comes first."""
    key = F.get(F.filter(F.map_keys(x["m"]), lambda k: F.lower(k) == name), F.lit(0))
    return F.coalesce(F.try_variant_get(x["o"], f"$.{name}", kind), F.when(x["odd"], F.try_variant_get(x["m"][key], "$", kind)))


def unwrapped(data: Column) -> Column:
    """The JSON value that text holds, without wrappings and envelopes; null where the text is no valid JSON.

    Each layer takes a quote or an envelope's name. Quotes within quotes double what escapes them, so a text has no more
    layers than the logarithm of its length and its envelopes together; they are taken off until none is left.
    """
    said = lambda c, word: (F.length(c) - F.length(F.replace(F.lower(c), F.lit(word), F.lit("")))) / len(word)
    escapes = said(data, "\\u")
    layered = F.ltrim(data).startswith('"') | (said(data, "payload") > 0) | (escapes > 0)
    most = (F.lit(2) + F.log2(F.length(data) + 1) + said(data, "payload") + escapes).cast("int")

    def is_text(v: Column) -> Column:
        return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))

    def opened(v: Column) -> Column:
        inner = F.when(is_text(v), parsed(F.try_variant_get(v, "$", "string"))).otherwise(v)
        return let(seen(inner), lambda x: F.coalesce(_field(x, "payload", "variant"), x["o"]))

    def state(v: Column) -> Column:
        more = let(seen(v), lambda x: is_text(x["o"]) | _field(x, "payload", "variant").isNotNull())
        return F.struct(v.alias("v"), F.coalesce(more, F.lit(False)).alias("more"))

    def step(at: Column, _: Column) -> Column:
        return F.when(at["more"], let(opened(at["v"]), state)).otherwise(at)

    return let(parsed(data), lambda v: F.when(layered, F.aggregate(F.sequence(F.lit(1), most), state(v), step)["v"]).otherwise(v))


def _plain(text: Column) -> Column:
    return F.trim(F.translate(text, OTHER_DIGITS, "01234567890123456789"))


def _number(text: Column) -> Column:
    return let(F.regexp_replace(_plain(text), r"^(\d+)\.0+$", "$1"), lambda s: F.when(s.rlike(r"^\d{1,9}$"), s.cast("int")))


def _places(x: Column) -> Column:
    """`surah, ayah` of a `seen` object, however it holds them."""

    def of(ref: Column) -> Column:
        text = F.when(ref["m"].isNull(), F.split(_plain(F.try_variant_get(ref["o"], "$", "string")), r"\s*:\s*"))

        def place(parts: Column, name: str, at: int) -> Column:
            return F.coalesce(_number(_field(x, name, "string")), _number(_field(ref, name, "string")), F.when(F.size(parts) == 2, _number(parts[at]))).alias(name)

        return let(text, lambda parts: F.struct(place(parts, "surah", 0), place(parts, "ayah", 1)))

    return let(seen(_field(x, "ref", "variant")), of)


#: Fields of children besides `surah` and `ayah`, and the arrays of an event that hold the children.
CHILD_FIELDS = {
    "candidate": {"score": "double", "surah_name": "string"},
    "surrounding": {"text": "string", "is_current": "boolean"},
}
CHILD_ARRAYS = {"candidate": "candidates", "surrounding": "surrounding_verses"}
#: Kinds of an event's children: those, and the objects that have no table of their own.
EVENT_CHILDREN = (*CHILD_ARRAYS, "part")


def _json(m: Column) -> Column:
    return F.when(F.size(m) > 0, F.to_json(m))


def _others(x: Column, kind: str) -> Column:
    """JSON of the fields that the flat table has no column for; null if there are none."""
    known = ["surah", "ayah", "ref", *CHILD_FIELDS[kind]]
    return let(F.map_filter(x["m"], lambda k, _: ~F.lower(k).isin(known)), _json)


def _child(kind: str) -> Callable[[Column], Column]:
    def held(x: Column, at: Column) -> Column:
        own = F.struct(at["surah"].alias("surah"), at["ayah"].alias("ayah"), *[_field(x, n, t).alias(n) for n, t in CHILD_FIELDS[kind].items()], _others(x, kind).alias("others"))
        ref = F.when(at["surah"].isNotNull() & at["ayah"].isNotNull(), F.concat_ws(":", at["surah"], at["ayah"])).otherwise("")
        return let(own, lambda o: F.struct(identity(kind, o, ("surah", "ayah", *CHILD_FIELDS[kind], "others")).alias("id"), o.alias("own"), ref.alias("label")))

    return lambda o: let(seen(o), lambda x: F.when(x["m"].isNotNull(), let(_places(x), lambda at: held(x, at))))


def _part(e: Column) -> Column:
    own = F.struct(e["key"].alias("name"), F.to_json(e["value"]).alias("content"))
    return let(own, lambda o: F.struct(identity("part", o, ("name", "content")).alias("id"), o.alias("own"), F.lit("").alias("label")))


def _event(e: Column) -> Column:
    def of(x: Column) -> Column:
        apart = lambda k, v: F.lower(k).isin(*CHILD_ARRAYS.values())
        is_part = lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
        rest = F.map_filter(x["m"], lambda k, v: ~apart(k, v))
        parts = F.map_filter(rest, lambda k, v: is_part(v))
        data = F.when(x["m"].isNotNull(), F.to_json(F.map_filter(rest, lambda k, v: ~is_part(v)))).otherwise(F.to_json(x["o"]))
        own = F.struct(e["ts_ms"].alias("ts_ms"), F.lower(e["event_type"]).alias("event_type"), data.alias("data"), F.when(x["o"].isNull(), e["data"]).alias("unread"))
        children = [F.transform(_field(x, name, "array<variant>"), _child(kind)).alias(kind) for kind, name in CHILD_ARRAYS.items()]

        def held(c: Column) -> Column:
            ids = [F.transform(c[k], lambda o: o["id"]) for k in EVENT_CHILDREN]
            return F.struct(identity("event", c["own"], ("ts_ms", "event_type", "data", "unread"), *ids).alias("id"), c["own"].alias("own"), *[c[k].alias(k) for k in EVENT_CHILDREN])

        return let(F.struct(own.alias("own"), *children, F.transform(F.map_entries(parts), _part).alias("part")), held)

    return F.when(e.isNotNull(), let(seen(unwrapped(e["data"])), of))


def event_nodes(diagnostics: DataFrame, contents: bool = True) -> DataFrame:
    """The written nodes of all places of `events`, with their candidates, surrounding verses and parts."""
    return _nodes(diagnostics, "diag_id", "events", _event, EVENT_CHILDREN, contents)


# --- store and flat tables ------------------------------------------------------------------------------------------


def _nodes(records: DataFrame, key: str, field: str, node: Callable[[Column], Column], children: Sequence[str], contents: bool) -> DataFrame:
    """A written table, one row a place of the array of each delivery: `root_id, record, ordinal, id`, of each kind of child
    `<kind>_ids` and `<kind>_labels`, and with `contents` also `own` and `<kind>_own` in JSON.

    `record` is the identity of the delivery, over those of its nodes. Places of null elements have a null `id`.
    """

    def whole(nodes: Column) -> Column:
        return F.struct(_hash(_listed(F.transform(nodes, lambda n: n["id"]))).alias("record"), nodes.alias("nodes"))

    # A generator's output is computed once; a projection's would be copied into every expression above it.
    there = spread(records.select(key, field).where(F.col(key).isNotNull() & (F.size(field) > 0)), key)
    read = there.select(F.col(key).alias("root_id"), F.explode(F.array(let(F.transform(field, node), whole))).alias("r"))
    placed = read.select("root_id", "r.record", F.posexplode("r.nodes").alias("ordinal", "n"))
    own = [F.to_json("n.own").alias("own"), *[F.transform(f"n.{k}", lambda c: F.when(c.isNotNull(), F.to_json(c["own"]))).alias(f"{k}_own") for k in children]] if contents else []
    links = [F.col(f"n.{k}")[part].alias(f"{k}_{part}s") for k in children for part in ("id", "label")]
    return written(placed.select("root_id", "record", "ordinal", F.col("n.id").alias("id"), *links, *own))


def _current(nodes: DataFrame) -> DataFrame:
    """Nodes of one delivery of each record, each place once. The deliveries' identities are compared by record; only ids
    are shuffled."""
    places = nodes.groupBy("root_id", "record", "ordinal").agg(F.max("id").alias("id"))
    counts = nodes.groupBy("root_id").agg(F.max("record").alias("record"))
    return places.join(counts, ["root_id", "record"])


def _store(nodes: DataFrame, root_kind: str, field: str, kind: str, children: Sequence[str]) -> Store:
    current = _current(nodes)
    roots = current.select(F.lit(root_kind).alias("root_kind"), "root_id", F.lit(field).alias("field"), "ordinal", F.col("id").alias("child_id"))
    linked = _linked(nodes, children)
    bridge = None
    for child in children:
        at = linked.select("parent_id", F.lit(child).alias("field"), F.posexplode(f"{child}_labels").alias("ordinal", "label"), f"{child}_ids")
        at = at.select("parent_id", "field", "ordinal", F.col(f"{child}_ids")[F.col("ordinal")].alias("child_id"), "label")
        bridge = at if bridge is None else bridge.unionByName(at)
    if "own" not in nodes.columns:
        return Store(roots, bridge, None, linked, tuple(children))
    # Occurrences are those of the deliveries that count.
    there = nodes.where(F.col("id").isNotNull())
    held = current.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    once = there.groupBy("id").agg(F.any_value("own").alias("own"), *[F.any_value(f"{k}_{part}").alias(f"{k}_{part}") for k in children for part in ("ids", "own")]).join(held, "id")
    objects = once.select(F.col("id").alias("object_id"), F.lit(kind).alias("kind"), F.col("own").alias("content"), F.col("n").alias("occurrences"))
    for child in children:
        each = once.select("n", F.explode(F.arrays_zip(F.col(f"{child}_ids").alias("id"), F.col(f"{child}_own").alias("own"))).alias("c")).where("c.id IS NOT NULL")
        met = each.groupBy(F.col("c.id").alias("object_id")).agg(F.any_value("c.own").alias("content"), F.sum("n").alias("occurrences"))
        objects = objects.unionByName(met.select("object_id", F.lit(child).alias("kind"), "content", "occurrences"))
    return Store(roots, bridge, objects, linked, tuple(children))


def _linked(nodes: DataFrame, children: Sequence[str]) -> DataFrame:
    """`parent_id` and the links of each distinct node that has children."""
    has = F.lit(False)
    for k in children:
        has = has | (F.coalesce(F.size(f"{k}_labels"), F.lit(0)) > 0)
    links = [f"{k}_{part}s" for k in children for part in ("id", "label")]
    return nodes.where(F.col("id").isNotNull() & has).groupBy(F.col("id").alias("parent_id")).agg(*[F.any_value(c).alias(c) for c in links])


def layout_store(pages: DataFrame, contents: bool = True) -> Store:
    return _store(layout_nodes(pages, contents), "page", "lines", "line", ("word",))


def event_store(diagnostics: DataFrame, contents: bool = True) -> Store:
    return _store(event_nodes(diagnostics, contents), "diagnostic", "events", "event", EVENT_CHILDREN)


def occurrences(store: Store) -> DataFrame:
    """`child, root_id, outer_pos, inner_pos, verse_ref, parent_id, child_id` of every object at the second level.

    Roots meet the links of their nodes before these are laid out, so a node's links are shuffled once; a node that very
    many roots hold is split by AQE, as both sides of the join come straight from a shuffle.
    """
    roots = store.roots.where(F.col("child_id").isNotNull()).select("root_id", F.col("ordinal").alias("outer_pos"), F.col("child_id").alias("parent_id"))
    met = roots.join(store.linked.repartition("parent_id"), "parent_id")
    out = None
    for child in store.children:
        if child == "part":
            continue
        at = met.select("root_id", "outer_pos", "parent_id", F.posexplode(f"{child}_labels").alias("inner_pos", "verse_ref"), f"{child}_ids").where(F.col("verse_ref").isNotNull())
        at = at.select(F.lit(child).alias("child"), "root_id", "outer_pos", "inner_pos", "verse_ref", "parent_id", F.col(f"{child}_ids")[F.col("inner_pos")].alias("child_id"))
        out = at if out is None else out.unionByName(at)
    return out


def all_occurrences(pages: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """`occurrences` of both tables."""
    return occurrences(layout_store(pages, contents=False)).unionByName(occurrences(event_store(diagnostics, contents=False)))


def _placed(records: DataFrame, key: str, field: str, node: Callable[[Column], Column], kind: str) -> DataFrame:
    """`root_id, ordinal, n` of every place of an array, of one delivery each."""
    one = one_per_id(records, key, field)
    at = one.select(F.col(key).alias("root_id"), F.posexplode(field).alias("ordinal", "e"))
    return at.select("root_id", "ordinal", F.explode(F.array(node(F.col("e")))).alias(kind))


def layout_lines(pages: DataFrame) -> DataFrame:
    """`root_id, ordinal, line` of every place of `lines`; `line` has id, own fields and identified words."""
    return _placed(pages, "page_id", "lines", _line, "line")


def event_objects(diagnostics: DataFrame) -> DataFrame:
    """`root_id, ordinal, event` of every place of `events`; `event` has id, own fields and identified children."""
    return _placed(diagnostics, "diag_id", "events", _event, "event")


def pages_table(pages: DataFrame) -> DataFrame:
    """`page_id, edition, page, n_lines` (null for a page without layout)."""
    one = one_per_id(pages, "page_id", "edition", "page", "lines")
    return one.select("page_id", "edition", "page", F.when(F.col("lines").isNotNull(), F.size("lines")).alias("n_lines"))


def lines_table(pages: DataFrame) -> DataFrame:
    """`page_id, outer_pos` and a line's own fields and `n_words` (null where it has no words)."""
    at = layout_lines(pages).where(F.col("line").isNotNull())
    return at.select(F.col("root_id").alias("page_id"), F.col("ordinal").alias("outer_pos"), "line.own.*", F.when(F.col("line.word").isNotNull(), F.size("line.word")).alias("n_words"))


def words_table(pages: DataFrame) -> DataFrame:
    """`page_id, outer_pos, inner_pos` and a word's own fields."""
    at = layout_lines(pages).select("root_id", "ordinal", F.posexplode("line.word").alias("inner_pos", "w")).where(F.col("w").isNotNull())
    return at.select(F.col("root_id").alias("page_id"), F.col("ordinal").alias("outer_pos"), "inner_pos", "w.own.*")


def events_table(diagnostics: DataFrame) -> DataFrame:
    """`diag_id, outer_pos, ts_ms, event_type` (in lower case), whether `data` was read, and the numbers of children."""
    at = event_objects(diagnostics).where(F.col("event").isNotNull())
    n = [F.when(F.col(f"event.{k}").isNotNull(), F.size(f"event.{k}")).alias(f"n_{name}") for k, name in CHILD_ARRAYS.items()]
    return at.select(F.col("root_id").alias("diag_id"), F.col("ordinal").alias("outer_pos"), "event.own.ts_ms", "event.own.event_type", F.col("event.own.data").isNotNull().alias("is_read"), *n)


#: Fields of an event's `data` beside `surah` and `ayah` that hold one value, and the array that holds numbers.
EVENT_FIELDS = {"word_index": "int", "total_words": "int", "confidence": "double", "transcript": "string", "text": "string"}
INDICES = "matched_indices"


def _read_events(diagnostics: DataFrame) -> DataFrame:
    """`diag_id, outer_pos, v` of every event that was read; `v` is its data, as `seen`."""
    at = one_per_id(diagnostics, "diag_id", "events").select("diag_id", F.posexplode("events").alias("outer_pos", "e")).where(F.col("e").isNotNull())
    return at.select("diag_id", "outer_pos", F.explode(F.array(seen(unwrapped(F.col("e.data"))))).alias("v"))


def event_fields_table(diagnostics: DataFrame) -> DataFrame:
    """`diag_id, outer_pos, surah, ayah`, EVENT_FIELDS and `n_matched_indices` (null where there is no such array) of the
    data of every event, one row an event as in `events_table`; JSON of all other fields but the children in `others`."""
    v = F.col("v")
    number = {"int": lambda n: _number(_field(v, n, "string")), "double": lambda n: _plain(_field(v, n, "string")).try_cast("double")}
    own = [number.get(t, lambda n: _field(v, n, "string"))(n).alias(n) for n, t in EVENT_FIELDS.items()]
    known = ["surah", "ayah", "ref", INDICES, *EVENT_FIELDS, *CHILD_ARRAYS.values()]
    rest = F.map_filter(v["m"], lambda k, _: ~F.lower(k).isin(known))
    n = F.size(_field(v, INDICES, "array<variant>"))
    placed = _read_events(diagnostics).withColumn("at", F.when(v["m"].isNotNull(), _places(v)))
    return placed.select("diag_id", "outer_pos", "at.surah", "at.ayah", *own, F.when(n >= 0, n).alias("n_matched_indices"), F.when(F.size(rest) > 0, F.to_json(rest)).alias("others"))


def indices_table(diagnostics: DataFrame) -> DataFrame:
    """`diag_id, outer_pos, inner_pos, word` of every place of an event's `matched_indices`; null where it is no number."""
    at = _read_events(diagnostics).select("diag_id", "outer_pos", F.posexplode(_field(F.col("v"), INDICES, "array<variant>")).alias("inner_pos", "i"))
    return at.select("diag_id", "outer_pos", "inner_pos", _number(F.try_variant_get("i", "$", "string")).alias("word"))


def children_table(diagnostics: DataFrame, kind: str) -> DataFrame:
    """`diag_id, outer_pos, inner_pos`, a candidate's or surrounding verse's own fields and `verse_ref`."""
    at = event_objects(diagnostics).select("root_id", "ordinal", F.posexplode(f"event.{kind}").alias("inner_pos", "c")).where(F.col("c").isNotNull())
    return at.select(F.col("root_id").alias("diag_id"), F.col("ordinal").alias("outer_pos"), "inner_pos", "c.own.*", F.col("c.label").alias("verse_ref"))
