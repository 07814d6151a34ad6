"""Schemas that drift between files (problem 5).

Method: every file gets a schema fingerprint (its fields with their types).  Files of
one store and record kind are put in order, and equal neighbours share a version.  Only
where the fingerprint changes are the steps between two versions derived: a field
renamed (the records of both files keep their values under the new name), added,
removed or retyped.  The steps are a table.  ``routes`` executes it: renames are
chained into the column that each field of each file goes to, and every file is routed
through its chain, with null as default for what it lacks and casts to the column's type,
into one table per kind.  What no column takes is kept in ``extras``.

Values are compared only for the fields that come or go, in the two files of the step,
as hashes; the lines are parsed once and stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark.functions import notation
from mnemospark.operators import graph
from mnemospark.store import Scratch

#: JSON types, each a bit of a field's type set in a file.
TYPES = ("string", "number", "boolean", "array", "object")

#: The columns of the common tables and the stored name that each is read from.
COLUMNS = {
    "anchor": {
        "id": "id", "text": "text", "tags": "tags", "created_at": "created_at", "source_session": "source_session", "replay_count": "replay_count", "state": "state",
        "state_history": "state_history_json", "community_id": "community_id", "thermal_state": "thermal_state", "segment_id": "segment_id", "salience": "salience", "is_core": "is_core",
    },
    "edge": {
        "source": "source", "target": "target", "weight": "weight", "edge_type": "edge_type", "co_activation_count": "co_activation_count", "created_at": "created_at",
        "confidence": "confidence", "is_stale": "is_stale", "causal_strength": "causal_strength", "temporal_order": "temporal_order",
    },
}

#: Further names by stored name, for fields that no rename ties to a known one; the queries do without.
ALIASES = {
    "anchor": {
        "state": ("State", "status", "lifecycle", "lifecycle_state", "memory_state", "phase"),
        "state_history_json": ("stateHistoryJson", "state_history", "state_log", "history", "transitions"),
        "source_session": ("session", "session_id", "sourceSession"),
        "replay_count": ("replayCount", "replays"),
    },
    "edge": {
        "edge_type": ("edgeType", "relation", "rel", "type", "link_kind"),
        "weight": ("w", "strength"),
        "co_activation_count": ("coactivations", "co_count"),
    },
}

#: A file of a store and kind.
FILE = ("store_name", "record_kind", "file_name")
STORE = FILE[:2]

#: Shapes of values that two names of one column must share, as a part of the rarer name's shapes.
SHAPE_SHARE = 0.8


def valid_lines(raw: DataFrame) -> DataFrame:
    """The lines that count, as (store_name, record_kind, file_name, exported_at, line_no, record).

    ``record`` is the payload as a variant.  Of a line that was loaded more than once
    the earliest load counts, and of equal loads the least payload.  Lines that are no
    JSON object, and lines without a file name or kind, are left out.
    """
    first = F.min_by("payload", F.struct("loaded_at", "payload"))
    lines = raw.filter("file_name is not null and record_kind is not null").groupBy(*FILE, "line_no").agg(first.alias("payload"), F.min("exported_at").alias("exported_at"))
    parsed = lines.filter(F.col("payload").rlike(r"^\s*\{")).select(*FILE, "exported_at", "line_no", F.try_parse_json("payload").alias("record"))
    return parsed.filter(F.schema_of_variant("record").startswith("OBJECT"))


def cells(lines: DataFrame) -> DataFrame:
    """The lines with the top-level fields of each as ``fields``, a map<string, variant>."""
    return lines.withColumn("fields", F.expr("cast(record as map<string, variant>)"))


def stored_lines(raw: DataFrame, scratch: Scratch) -> DataFrame:
    """``valid_lines`` written once, with their fields."""
    return cells(scratch.keep(valid_lines(raw)))


def _type_bit(v: Column) -> Column:
    """The bit of a value's JSON type; 0 for null."""
    name = F.schema_of_variant(v)
    return (
        F.when(name == "STRING", 1).when(name.startswith("OBJECT"), 16).when(name.startswith("ARRAY"), 8).when(name == "BOOLEAN", 4).when(name == "VOID", 0).otherwise(2)
    )


def type_names(bits: Column) -> Column:
    """The names of a type set, joined by ``|``; empty if all values were null."""
    return F.concat_ws("|", *[F.when(bits.bitwiseAND(1 << n) > 0, F.lit(t)) for n, t in enumerate(TYPES)])


def fingerprints(lines: DataFrame) -> DataFrame:
    """Each file's fields with their type sets, their hash, its version, and the file before it.

    (store_name, record_kind, file_name, exported_at, fields, fingerprint, seq, version,
    old_file, old_fields, old_fingerprint); files are ordered by exported_at and name.
    A version goes on as long as the fingerprint stays.
    """
    each = lines.select(*FILE, "exported_at", F.explode("fields").alias("field", "v"))
    per_field = each.groupBy(*FILE, "field").agg(F.bit_or(_type_bit(F.col("v"))).alias("type"), F.min("exported_at").alias("exported_at"))
    fields = F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "type"))))
    files = per_field.groupBy(*FILE).agg(F.min("exported_at").alias("exported_at"), fields.alias("fields")).withColumn("fingerprint", F.sha2(F.to_json("fields"), 256))
    ordered = W.partitionBy(*STORE).orderBy("exported_at", "file_name")
    before = files.select(
        "*", F.row_number().over(ordered).alias("seq"), F.lag("file_name").over(ordered).alias("old_file"), F.lag("fields").over(ordered).alias("old_fields"),
        F.lag("fingerprint").over(ordered).alias("old_fingerprint"),
    )
    changed = F.coalesce(F.col("fingerprint") != F.col("old_fingerprint"), F.lit(True)).cast("int")
    return before.withColumn("version", F.sum(changed).over(ordered))


def _renames(lines: DataFrame, changed: DataFrame) -> DataFrame:
    """(store_name, record_kind, file_name, renames): old and new names, one to one, best kept first.

    A name that goes and one that comes are the same field if every record that has a
    value under both in the two files keeps it, and there is at least one such record.
    Of a record that a file holds more than once the least hash of its values counts.
    """
    moved = changed.filter("size(gone) > 0 and size(came) > 0")
    side = lambda file, names, old: moved.select(*STORE, F.col(file).alias("file_name"), F.col("file_name").alias("to_file"), F.col(names).alias("names"), F.lit(old).alias("old"))
    wanted = side("old_file", "gone", True).unionByName(side("file_name", "came", False))
    id_of = lambda *names: F.concat(*[x for n in names for x in (F.expr(f"to_json(try_variant_get(record, '$.{n}', 'variant'))"), F.lit("\u0001"))])
    rid = F.when(F.col("record_kind") == "edge", id_of("source", "target")).otherwise(id_of("id"))
    held = F.map_filter("fields", lambda k, v: F.array_contains("names", k) & ~F.is_variant_null(v))
    at = [*STORE, "to_file", "rid"]
    values = lines.join(wanted, [*FILE]).select(*STORE, "to_file", rid.alias("rid"), "old", F.explode(held).alias("field", "v")).filter("rid is not null")
    values = values.select(*at, "old", "field", F.xxhash64(F.to_json("v")).alias("h")).repartition(*at)
    once = values.groupBy(*at, "old", "field").agg(F.min("h").alias("h"))
    of = lambda old: F.collect_list(F.when(F.col("old") == F.lit(old), F.struct("field", "h")))
    sides = once.groupBy(*at).agg(of(True).alias("olds"), of(False).alias("news")).select(*at, F.explode("olds").alias("o"), "news").select(*at, "o", F.explode("news").alias("n"))
    pairs = (
        sides.groupBy(*STORE, F.col("to_file").alias("file_name"), F.col("o.field").alias("old_name"), F.col("n.field").alias("new_name"))
        .agg(F.count("*").alias("n"), F.sum((F.col("o.h") == F.col("n.h")).cast("long")).alias("same"))
        .filter("same = n")
    )
    # greedy one to one over the few candidates of a file, until none has both names left
    best = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("least"), "old_name", "new_name")))
    used = lambda taken, x: F.exists(taken, lambda y: (y["old_name"] == x["old_name"]) | (y["new_name"] == x["new_name"]))
    none = F.array().cast("array<struct<least:bigint,old_name:string,new_name:string>>")
    matched = F.aggregate("best", none, lambda taken, x: F.when(used(taken, x), taken).otherwise(F.concat(taken, F.array(x))))
    return pairs.groupBy(*FILE).agg(best.alias("best")).select(*FILE, matched.alias("renames"))


def steps(lines: DataFrame, prints: DataFrame) -> DataFrame:
    """The migration steps: every change between a file and the one before it, with the rule it stands for.

    (store_name, record_kind, file_name, seq, from_version, to_version, change_kind,
    old_name, new_name, old_type, new_type).  A field whose values are all null in
    either file has no type there and is not retyped.
    """
    keys = lambda c: F.map_keys(c)
    changed = prints.filter("old_fingerprint != fingerprint").withColumns(
        {"gone": F.array_except(keys("old_fields"), keys("fields")), "came": F.array_except(keys("fields"), keys("old_fields"))}
    )
    done = changed.join(_renames(lines, changed), list(FILE), "left")
    c = F.col
    left = lambda names, side: F.filter(names, lambda x: ~F.coalesce(F.exists("renames", lambda r: r[side] == x), F.lit(False)))
    row = lambda kind, old, new: F.struct(F.lit(kind).alias("change_kind"), old.alias("old_name"), new.alias("new_name"))
    none = F.lit("")
    both = F.filter(keys("fields"), lambda x: (c("fields")[x] > 0) & (F.coalesce(c("old_fields")[x], F.lit(0)) > 0) & (c("old_fields")[x] != c("fields")[x]))
    rows = F.concat(
        F.coalesce(F.transform("renames", lambda r: row("renamed", r["old_name"], r["new_name"])), F.array().cast("array<struct<change_kind:string,old_name:string,new_name:string>>")),
        F.transform(left("gone", "old_name"), lambda x: row("removed", x, none)), F.transform(left("came", "new_name"), lambda x: row("added", none, x)),
        F.transform(both, lambda x: row("retyped", x, x)),
    )
    out = done.select(*FILE, "seq", F.col("version").alias("to_version"), "old_fields", "fields", F.explode(rows).alias("s"))
    return out.select(
        *FILE, "seq", (c("to_version") - 1).alias("from_version"), "to_version", "s.change_kind", "s.old_name", "s.new_name",
        F.coalesce(type_names(c("old_fields")[c("s.old_name")]), none).alias("old_type"), F.coalesce(type_names(c("fields")[c("s.new_name")]), none).alias("new_type"),
    )


def changes(raw: DataFrame) -> DataFrame:
    """Every change of a field between a file and the nearest earlier one of its store and kind.

    ``steps`` of the valid lines; change_kind is renamed, added, removed or retyped.
    Empty input gives an empty result.
    """
    scratch = Scratch(raw.sparkSession, "drift")
    lines = stored_lines(raw, scratch)
    return steps(lines, scratch.keep(fingerprints(lines)))


def migration_steps(changes: DataFrame) -> DataFrame:
    """The changes with the rule each stands for in words: rename, default, drop or cast."""
    step = (
        F.when(F.col("change_kind") == "renamed", F.concat(F.lit("rename "), "old_name", F.lit(" to "), "new_name"))
        .when(F.col("change_kind") == "added", F.concat(F.lit("default "), "new_name", F.lit(" to null before")))
        .when(F.col("change_kind") == "removed", F.concat(F.lit("keep "), "old_name", F.lit(" as null after")))
        .otherwise(F.concat(F.lit("cast "), "new_name"))
    )
    return changes.withColumn("step", step)


def _known(kind: Column, name: Column, aliases: dict | None) -> Column:
    """The stored name of a column for a name that is one, or that ``aliases`` lists; null for others."""
    out = F.lit(None).cast("string")
    for k, columns in COLUMNS.items():
        out = F.when((kind == k) & name.isin(*columns.values()), name).otherwise(out)
        for target, names in (aliases or {}).get(k, {}).items():
            out = F.when((kind == k) & name.isin(*names), F.lit(target)).otherwise(out)
    return out


def _lives(prints: DataFrame, done: DataFrame, scratch: Scratch) -> DataFrame:
    """Each field of each file with the chain of renames that it belongs to.

    (store_name, record_kind, file_name, field, root, root_start, reused).  A name's life
    within a store starts in the file where it comes; a rename step ties the new life to
    the old one, and the ties are chained back to the first life by pointer jumping.
    ``reused`` says that the chain began under a name that had been renamed away.
    """
    at = list(STORE)
    seen = prints.select(*at, "file_name", "seq", F.explode(F.map_keys("fields")).alias("field"))
    by_name = W.partitionBy(*at, "field").orderBy("seq")
    fresh = F.coalesce(F.lag("seq").over(by_name) != F.col("seq") - 1, F.lit(True))
    lives = scratch.keep(seen.withColumn("start", F.when(fresh, F.col("seq"))).withColumn("start", F.last("start", True).over(by_name)))
    old_life = lives.select(*at, F.col("field").alias("old_name"), (F.col("seq") + 1).alias("seq"), F.col("start").alias("old_start"))
    tie = done.filter("change_kind = 'renamed'").join(old_life, [*at, "old_name", "seq"])
    ties = first = scratch.keep(tie.select(*at, F.col("new_name").alias("field"), F.col("seq").alias("start"), F.col("old_name").alias("root"), F.col("old_start").alias("root_start")))
    while True:
        onward = ties.select(*at, F.col("field").alias("root"), F.col("start").alias("root_start"), F.col("root").alias("further"), F.col("root_start").alias("further_start"))
        jumped = scratch.keep(
            ties.join(onward, [*at, "root", "root_start"], "left").select(
                *at, "field", "start", F.coalesce("further", "root").alias("root"), F.coalesce("further_start", "root_start").alias("root_start"), F.col("further").isNotNull().alias("moved")
            )
        )
        ties = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            break
    left = first.groupBy(*at, F.col("root").alias("left_name")).agg(F.min("start").alias("left_at"))
    rooted = lives.join(ties, [*at, "field", "start"], "left").select(
        *at, "file_name", "field", F.coalesce("root", "field").alias("root"), F.coalesce("root_start", "start").alias("root_start")
    )
    gone = rooted.join(left.withColumnRenamed("left_name", "root"), [*at, "root"], "left")
    return gone.select(*at, "file_name", "field", "root", "root_start", F.coalesce(F.col("left_at") < F.col("root_start"), F.lit(False)).alias("reused"))


def _alike(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(record_kind, a, b): names that no file has side by side and whose values have the same shapes.

    A shape is a value's JSON with every number as ``#``; shapes without a letter say
    nothing.  All shapes of each name are compared: at least ``SHAPE_SHARE``
    of those of the name with fewer must be among the other's.
    """
    values = lines.select("record_kind", F.explode("fields").alias("field", "v")).filter(~F.is_variant_null("v"))
    shape = F.regexp_replace(F.to_json("v"), r"[0-9]+(?:\.[0-9]+)?", "#")
    shapes = values.select("record_kind", "field", shape.alias("s")).filter(F.col("s").rlike("[A-Za-z]{3}") & ~F.col("s").isin("true", "false"))
    each = shapes.select("record_kind", "field", F.xxhash64("s").alias("h")).distinct()
    # names are few: the names of a shape are a set, and sets are counted before they are paired
    sets = each.groupBy("record_kind", "h").agg(F.array_sort(F.collect_list("field")).alias("fields")).groupBy("record_kind", "fields").agg(F.count("*").alias("n"))
    one = sets.select("record_kind", "fields", "n", F.explode("fields").alias("a"))
    sizes = one.groupBy("record_kind", F.col("a").alias("field")).agg(F.sum("n").alias("size"))
    common = one.select("record_kind", "n", "a", F.explode("fields").alias("b")).filter("a < b").groupBy("record_kind", "a", "b").agg(F.sum("n").alias("n"))
    of = lambda x: sizes.select("record_kind", F.col("field").alias(x), F.col("size").alias(f"size_{x}"))
    likely = common.join(of("a"), ["record_kind", "a"]).join(of("b"), ["record_kind", "b"]).filter(F.col("n") >= SHAPE_SHARE * F.least("size_a", "size_b"))
    x, y = (names.select(*FILE, F.col("field").alias(n)).distinct() for n in "ab")
    beside = x.join(y, list(FILE)).filter("a < b").select("record_kind", "a", "b").distinct()
    return likely.join(beside, ["record_kind", "a", "b"], "left_anti").select("record_kind", "a", "b")


def routes(lines: DataFrame, scratch: Scratch, aliases: dict | None = ALIASES) -> DataFrame:
    """(store_name, record_kind, file_name, field, target): where each field of each file goes in the common table.

    The renames of a store are chained (``_lives``).  Across stores, names are one column
    if a rename of any store ties them or their values are alike.  A chain goes to the
    column that one of its names or of the names tied to them is the stored name of, else
    to the name that most files have.  A name that was renamed away and comes anew is
    another field and keeps its name.  ``aliases`` adds names known beforehand.
    """
    prints = scratch.keep(fingerprints(lines))
    done = scratch.keep(steps(lines, prints))
    lives = scratch.keep(_lives(prints, done, scratch))
    tied = done.filter("change_kind = 'renamed'").select("record_kind", F.col("old_name").alias("a"), F.col("new_name").alias("b"))
    node = lambda c: F.concat_ws("\u0001", "record_kind", c)
    links = scratch.keep(tied.unionByName(_alike(lines, lives)).select(node("a").alias("lo"), node("b").alias("hi")).distinct())
    groups = scratch.keep(graph.components(links).select(F.col("node").alias("name"), "component"))
    names = lives.filter("not reused").groupBy("record_kind", "field").agg(F.count("*").alias("n")).withColumn("name", node("field"))
    named = names.join(groups, "name", "left").withColumn("component", F.coalesce("component", "name")).withColumn("known", _known(F.col("record_kind"), F.col("field"), aliases))
    most = F.max_by("field", F.struct("n", "field"))
    column = named.groupBy("component").agg(F.coalesce(F.max_by("known", F.when(F.col("known").isNotNull(), F.col("n"))), most).alias("column"))
    targets = scratch.keep(named.join(column, "component").select("record_kind", "field", F.coalesce("known", "column").alias("column")))
    rooted = lives.join(targets.withColumnRenamed("field", "root"), ["record_kind", "root"], "left")
    target = F.when(F.col("reused"), F.col("root")).otherwise(F.coalesce("column", "root"))
    return rooted.select(*FILE, "field", target.alias("target"))


def _routed(raw: DataFrame, kind: str, aliases: dict | None) -> DataFrame:
    """The valid lines of a kind with the text of each column of the common table and the map ``extras``.

    ``extras`` holds what no column takes, by name.  What a file lacks is null.  Of two
    fields of a line that go to one name the greater text counts.
    """
    scratch = Scratch(raw.sparkSession, "drift")
    own = stored_lines(raw.filter(F.col("record_kind") == kind), scratch)
    by_file = scratch.keep(routes(own, scratch, aliases).groupBy(*FILE).agg(F.map_from_entries(F.collect_list(F.struct("field", "target"))).alias("route")))
    text = lambda v: F.when(~F.is_variant_null(v), F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))
    entry = lambda e: F.struct(F.col("route")[e["key"]].alias("key"), text(e["value"]).alias("value"))
    lines = own.join(by_file, list(FILE), "left").withColumn("cells", F.array_sort(F.transform(F.map_entries("fields"), entry)))
    last = lambda x, i: F.coalesce(F.get("cells", i + 1)["key"] != x["key"], F.lit(True))
    routed = lines.withColumn("cells", F.map_from_entries(F.filter("cells", last)))
    columns = COLUMNS[kind]
    extras = F.map_filter("cells", lambda k, v: ~k.isin(*columns.values()))
    return routed.select("store_name", "file_name", "exported_at", "line_no", *[F.col("cells")[stored].alias(c) for c, stored in columns.items()], extras.alias("extras"))


def history(c: Column | str) -> Column:
    """A state history in any notation as array<struct<state, at>> in the order given.

    Pairs ``[["active", 17.0]]``, objects ``[{"state": .., "ts": ..}]`` (milliseconds or
    seconds), one object ``{"active": 17.0}`` and ``active@17.0;ghost@18.0``.  Null, blank
    and unreadable histories give an empty array.
    """
    s = notation.strip(c)
    found = F.regexp_extract_all(s, F.lit(r"([A-Za-z_.]+|\b[0-5]\b)\"?\s*(?:@|,|:)\s*(?:\"[a-z_]+\"\s*:\s*)?\"?([0-9]{9,}(?:\.[0-9]+)?)"), F.lit(0))
    one = lambda x: F.struct(
        notation.state(F.regexp_extract(x, r"^([A-Za-z_.]+|[0-5])", 1)).alias("state"),
        F.regexp_extract(x, r"([0-9]{9,}(?:\.[0-9]+)?)$", 1).cast("double").alias("t"),
    )
    seconds = lambda x: F.struct(x["state"].alias("state"), F.when(x["t"] > 1e11, x["t"] / 1000).otherwise(x["t"]).alias("at"))
    return F.coalesce(F.transform(F.transform(found, one), seconds), F.array().cast("array<struct<state:string,at:double>>"))


def anchors_table(raw: DataFrame, aliases: dict | None = ALIASES) -> DataFrame:
    """The anchors of all files in one table, each file routed by its renames, with defaults and casts.

    One row for each valid line; values that cannot be cast are null.
    """
    c = F.col
    return _routed(raw, "anchor", aliases).select(
        "store_name", "file_name", "exported_at", "line_no", notation.key("id").alias("id"), "text", notation.tags("tags").alias("tags"),
        c("created_at").try_cast("double").alias("created_at"), "source_session", c("replay_count").try_cast("double").cast("bigint").alias("replay_count"),
        notation.state("state").alias("state"), history("state_history").alias("state_history"), "community_id", "thermal_state", "segment_id",
        c("salience").try_cast("double").alias("salience"), c("is_core").try_cast("boolean").alias("is_core"), "extras",
    )


def edges_table(raw: DataFrame, aliases: dict | None = ALIASES) -> DataFrame:
    """The edges of all files in one table, each file routed by its renames, with defaults and casts.

    One row for each valid line; values that cannot be cast are null.
    """
    c = F.col
    return _routed(raw, "edge", aliases).select(
        "store_name", "file_name", "exported_at", "line_no", notation.key("source").alias("source"), notation.key("target").alias("target"),
        c("weight").try_cast("double").alias("weight"), notation.edge_types("edge_type").alias("edge_types"),
        c("co_activation_count").try_cast("double").cast("bigint").alias("co_activation_count"), c("created_at").try_cast("double").alias("created_at"),
        c("confidence").try_cast("double").alias("confidence"), c("is_stale").try_cast("boolean").alias("is_stale"),
        c("causal_strength").try_cast("double").alias("causal_strength"), "temporal_order", "extras",
    )


def anchor_states(anchors: DataFrame) -> DataFrame:
    """(id, state, state_history) of stored anchors in one notation; repeated rows once."""
    return anchors.select(notation.key("id").alias("id"), notation.state("state").alias("state"), history("state_history_json").alias("state_history")).distinct()


def edge_relations(edges: DataFrame) -> DataFrame:
    """(edge_id, edge_types) of stored edges in one notation; repeated rows once."""
    return edges.select("edge_id", notation.edge_types("edge_type").alias("edge_types")).distinct()
