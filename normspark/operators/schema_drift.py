"""Schemas that drift between files: a column lifespan catalogue over JSON Lines records.

Every file leaves a footer in the catalogue: one row for each field it has, with the field's type.
Within a producer (``report_series``) the files follow each other by ``written_at``. Over
(producer, field) the catalogue is cut into islands of adjacent files; an island that starts after
the producer's first file is a start, one that ends before its last file an ending, and a type that
differs from the file before is a retyping. A start and an ending in the same file are one renaming
if the entries that both files hold agree on the values. The renamings link lifespans of a producer's fields; linked
lifespans are one column of the alias table, from which the casts of the consistent table are generated.

The lines are parsed once, to one row a field (``read_fields``), from which the log and the alias table are derived; the
consistent table parses them once more.

Defined results: a line that is null, empty, not JSON or not one object is unreadable and counts for
nothing, but its file keeps its place in the series. Of a key that a line repeats the last value counts. Rows
without series or file name have no place and are left out. Equal ``written_at``
are ordered by file name. A field whose values are all null has no type and is never retyped.
Further columns of the input are ignored. Empty input gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normspark.operators.duplicates import components
from normspark.session import broadcast_if_small, cut, require

INPUT = ["report_series", "file_name", "written_at", "line_no", "entry_id", "raw_record"]
KINDS = ["boolean", "double", "integer", "list", "object", "string"]
#: Integers beyond this have no exact double.
EXACT = 1 << 53
REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def read_records(raw: DataFrame) -> DataFrame:
    """The input rows with ``record``: the line as a variant, null where the line is unreadable.

    The line is parsed inside brackets, so that text after the object makes it invalid. Whether repeated keys are
    read is a setting of the session at the time of planning: see ``parsed``.
    """
    require(raw, INPUT)
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col("raw_record"), F.lit("]")))
    whole = F.expr("raw_record RLIKE '^\\\\s*[{]' AND raw_record RLIKE '[}]\\\\s*$'")
    return (
        raw.select(*INPUT)
        .withColumn("_w", wrapped)
        .withColumn("_second", F.try_variant_get("_w", "$[1]", "variant"))
        .withColumn("record", F.when(whole & F.col("_second").isNull(), F.try_variant_get("_w", "$[0]", "variant")))
        .drop("_w", "_second")
    )


def parsed(raw: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``build(raw)``, which reads records, computed and cut, with repeated keys allowed in the lines."""
    conf = raw.sparkSession.conf
    before = conf.get(REPEATED_KEYS)
    conf.set(REPEATED_KEYS, "true")
    try:
        return cut(build(raw))
    finally:
        conf.set(REPEATED_KEYS, before)


def kind_of(value: Column) -> Column:
    """boolean, integer, double, string, list or object of a variant; null for a JSON null.

    A number written with a fraction or an exponent is a double, ``12.0`` too; an integer of more
    than 18 digits is kept by Spark as a decimal without scale and counts as an integer.
    """
    t = F.schema_of_variant(value)
    head = F.substring(t, 1, 4)
    names = {"BIGI": "integer", "DOUB": "double", "FLOA": "double", "STRI": "string", "BOOL": "boolean", "ARRA": "list", "OBJE": "object"}
    decimal = F.when(t.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "integer").otherwise("double")  # 12.0 has fewer digits
    return F.when(head == "DECI", decimal).otherwise(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), head))


def explode_fields(records: DataFrame) -> DataFrame:
    """One row for each key of each readable record: ``field``, ``value`` (variant) and ``kind``."""
    spark = records.sparkSession
    # an unreadable record is null and has no keys; a filter on it would parse the line once more
    rows = spark.sql(
        "SELECT r.report_series, r.file_name, r.entry_id, e.key AS field, e.value AS value "
        "FROM {r} AS r, LATERAL variant_explode(r.record) AS e",
        r=records.where("report_series IS NOT NULL AND file_name IS NOT NULL"),
    )
    return rows.withColumn("kind", kind_of(F.col("value")))


def read_fields(raw: DataFrame) -> DataFrame:
    """The lines parsed: a row for each key of each readable record.

    ``report_series, file_name, entry_id, field, kind`` and ``same`` (a 64-bit hash of kind and value, null for
    a null; double values by their number).
    """
    text = F.when(F.col("kind") == "double", F.try_variant_get("value", "$", "double").cast("string")).otherwise(F.to_json("value"))
    return explode_fields(read_records(raw)).select("report_series", "file_name", "entry_id", "field", "kind", F.when(F.col("kind").isNotNull(), F.xxhash64("kind", text)).alias("same"))


def files_of(raw: DataFrame) -> DataFrame:
    """The files of each series with their place ``idx`` (from 1) and the series' number of files."""
    files = (
        raw.where("report_series IS NOT NULL AND file_name IS NOT NULL")
        .groupBy("report_series", "file_name")
        .agg(F.min("written_at").alias("written_at"))
    )
    w = Window.partitionBy("report_series")
    return files.select(
        "*",
        F.row_number().over(w.orderBy("written_at", "file_name")).alias("idx"),
        F.count(F.lit(1)).over(w).cast("int").alias("n_files"),
    )


def footers(fields: DataFrame, files: DataFrame) -> DataFrame:
    """The footer catalogue: ``report_series, file_name, idx, n_files, field, kind, n_values``.

    ``kind`` is the field's type in the file: its only kind, or double for integers among doubles,
    or the kinds joined by ``|`` where they don't agree.
    """
    has = {k: F.bool_or(F.col("kind").eqNullSafe(F.lit(k))).alias(k) for k in KINDS}
    seen = fields.groupBy("report_series", "file_name", "field").agg(*has.values(), F.count(F.lit(1)).alias("n_values"))
    names = F.array_compact(F.array(*(F.when(F.col(k) & ~F.col("double") if k == "integer" else F.col(k), F.lit(k)) for k in KINDS)))
    kind = F.when(F.size(names) > 0, F.array_join(names, "|"))
    return files.join(seen.select("report_series", "file_name", "field", kind.alias("kind"), "n_values"), ["report_series", "file_name"]).drop("written_at")


def catalogue(raw: DataFrame) -> DataFrame:
    """The footer catalogue of the lines ``raw``."""
    return footers(parsed(raw, read_fields), files_of(raw))


def lifespans(cat: DataFrame, by_kind: bool = True) -> DataFrame:
    """The islands of adjacent files in which a producer's field lives (with one type, if ``by_kind``).

    ``report_series, field, kind, first_idx, last_idx, n_files``.
    """
    w = Window.partitionBy("report_series", "field").orderBy("idx")
    fresh = (F.lag("idx").over(w).isNull()) | (F.col("idx") > F.lag("idx").over(w) + 1)
    if by_kind:
        fresh = fresh | ~F.lag("kind").over(w).eqNullSafe(F.col("kind"))
    return (
        cat.withColumn("_new", fresh.cast("int"))
        .withColumn("_island", F.sum("_new").over(w))
        .groupBy("report_series", "field", "_island")
        .agg(F.first("kind").alias("kind"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.first("n_files").alias("n_files"))
        .drop("_island")
    )


def _events(cat: DataFrame) -> DataFrame:
    """Starts, endings and retypings with the place of the file that shows them."""
    w = Window.partitionBy("report_series", "field").orderBy("idx")
    c = cat.withColumns({
        "_before": F.lag("idx").over(w),
        "_kind_before": F.lag("kind").over(w),
        "_after": F.lead("idx").over(w),
    })
    adjacent = F.coalesce(F.col("_before") == F.col("idx") - 1, F.lit(False))
    kinds = F.array_compact(
        F.array(
            F.when((F.col("idx") > 1) & ~adjacent, F.struct(F.lit("start").alias("event"), F.col("idx").alias("at"))),
            F.when(
                (F.col("idx") < F.col("n_files")) & F.coalesce(F.col("_after") > F.col("idx") + 1, F.lit(True)),
                F.struct(F.lit("end").alias("event"), (F.col("idx") + 1).alias("at")),
            ),
            F.when(adjacent & (F.col("kind") != F.col("_kind_before")), F.struct(F.lit("retyped").alias("event"), F.col("idx").alias("at"))),
        )
    )
    return c.select("report_series", "field", F.explode(kinds).alias("e")).select("report_series", "field", "e.event", "e.at")


def _renamings(fields: DataFrame, events: DataFrame, files: DataFrame) -> DataFrame:
    """(series, at, old, new) where the ending ``old`` and the start ``new`` agree on all shared entries."""
    sides = events.where("event <> 'retyped'").groupBy("report_series", "at").agg(F.bool_or(F.col("event") == "end").alias("e"), F.bool_or(F.col("event") == "start").alias("s"))
    # values to compare: of names that end in the file before, of names that start in the file
    wanted = (
        events.where("event <> 'retyped'")
        .join(sides.where("e AND s").select("report_series", "at"), ["report_series", "at"])
        .select("report_series", "at", "field", (F.col("event") == "end").alias("is_old"), (F.col("at") - (F.col("event") == "end").cast("int")).alias("idx"))
        .join(files.select("report_series", "file_name", "idx"), ["report_series", "idx"])
        .drop("idx")
    )
    values = (
        fields.where("same IS NOT NULL AND entry_id IS NOT NULL")
        .join(broadcast_if_small(cut(wanted)), ["report_series", "file_name", "field"])
        .groupBy("report_series", "at", "entry_id", "field", "is_old")
        .agg(F.min("same").alias("lo"), F.max("same").alias("hi"))
    )
    key = ["report_series", "at", "entry_id"]
    old = values.where("is_old").select(*key, F.col("field").alias("old"), F.col("lo").alias("old_lo"), F.col("hi").alias("old_hi"))
    new = values.where("NOT is_old").select(*key, F.col("field").alias("new"), "lo", "hi")
    same = (F.col("lo") == F.col("hi")) & (F.col("old_lo") == F.col("old_hi")) & (F.col("lo") == F.col("old_lo"))
    return old.join(new, key).groupBy("report_series", "at", "old", "new").agg(F.min(same).alias("same")).where("same").drop("same")


class Drift:
    """The parsed fields of the lines, the catalogue, and the renamings, each computed once."""

    def __init__(self, raw: DataFrame) -> None:
        self.fields = parsed(raw, read_fields)
        self.files = cut(files_of(raw))
        self.catalogue = cut(footers(self.fields, self.files))
        self.events = _events(self.catalogue)
        self.renamings = cut(_renamings(self.fields, self.events, self.files))

    def log(self) -> DataFrame:
        """Every change: ``report_series, file_name, drift_kind, field_before, field_after``."""
        key = ["report_series", "at"]
        done = self.renamings.select(*key, F.explode(F.array(F.struct(F.lit("end").alias("event"), F.col("old").alias("field")), F.struct(F.lit("start").alias("event"), F.col("new").alias("field")))).alias("e")).select(*key, "e.*").distinct()
        rest = self.events.join(broadcast_if_small(done), [*key, "event", "field"], "left_anti")
        empty = F.lit("")
        single = rest.select(
            *key,
            F.when(F.col("event") == "end", "removed").when(F.col("event") == "start", "added").otherwise("retyped").alias("drift_kind"),
            F.when(F.col("event") == "start", empty).otherwise(F.col("field")).alias("field_before"),
            F.when(F.col("event") == "end", empty).otherwise(F.col("field")).alias("field_after"),
        )
        log = single.unionByName(self.renamings.select(*key, F.lit("renamed").alias("drift_kind"), F.col("old").alias("field_before"), F.col("new").alias("field_after")))
        place = self.files.select("report_series", F.col("idx").alias("at"), "file_name")
        return log.join(place, key).select("report_series", "file_name", "drift_kind", "field_before", "field_after")

    def aliases(self) -> DataFrame:
        """The alias table: ``report_series, field, first_idx, last_idx, column``, one row a lifespan.

        Lifespans of a series that renamings link are one column, named by the field of the oldest. Series share columns
        by name. If two columns of one name live in the same file of a series, the one that began later is a column of its own: its name ends
        in ``@`` and the place of the file in which it began.
        """
        spans = lifespans(self.catalogue, by_kind=False).drop("kind", "n_files")
        node = F.concat_ws("\x01", "report_series", F.lpad(F.col("first_idx").cast("string"), 10, "0"), "field")
        spans = cut(spans.withColumn("node", node))
        old = spans.select("report_series", F.col("field").alias("old"), (F.col("last_idx") + 1).alias("at"), F.col("node").alias("key_a"))
        new = spans.select("report_series", F.col("field").alias("new"), F.col("first_idx").alias("at"), F.col("node").alias("key_b"))
        links = self.renamings.join(old, ["report_series", "at", "old"]).join(new, ["report_series", "at", "new"])
        linked = spans.join(components(links.select("key_a", "key_b")), "node", "left").withColumn("root", F.coalesce("component", "node"))
        linked = linked.withColumns({"column": F.element_at(F.split("root", "\x01"), 3), "began": F.element_at(F.split("root", "\x01"), 2).cast("int")})
        # columns of one name in one file
        at = linked.select("report_series", "column", "root", F.explode(F.sequence("first_idx", "last_idx")).alias("idx")).distinct()
        first = Window.partitionBy("report_series", "column", "idx").orderBy("root")
        later = at.withColumn("_place", F.row_number().over(first)).where("_place > 1").select("root").distinct()
        out = linked.join(later.withColumn("_own", F.lit(True)), "root", "left")
        return out.select("report_series", "field", "first_idx", "last_idx", F.when(F.col("_own"), F.concat("column", F.lit("@"), F.col("began").cast("string"))).otherwise(F.col("column")).alias("column"))


def drift_log(raw: DataFrame) -> DataFrame:
    """Every change: ``report_series, file_name, drift_kind, field_before, field_after``.

    ``renamed`` (old, new), ``removed`` (old, ''), ``added`` ('', new), ``retyped`` (name, name),
    each against the file before in the same series.
    """
    return Drift(raw).log()


def column_types(values: DataFrame) -> dict[str, str]:
    """Column -> the type that holds all its values; ``values``: ``column, value`` (variant).

    A list of strings where some values are lists; bigint, or decimal(38,0) where integers are longer; double for
    numbers, also where strings are numbers, unless an integer has no exact double; boolean; string for any other mixture. The driver
    gets one row for each column and kind: schema metadata.
    """
    known = values.withColumn("kind", kind_of(F.col("value")))
    long, whole, string = F.try_variant_get("value", "$", "bigint"), F.col("kind") == "integer", F.try_variant_get("value", "$", "string")
    fields = known.select(
        "column", "kind",
        F.when(F.col("kind").isin("integer", "double"), True).when(F.col("kind") == "string", string.try_cast("double").isNotNull()).otherwise(False).alias("numeric"),
        (whole & long.isNull()).alias("wide"),
        (whole & ~F.coalesce(long.between(-EXACT, EXACT), F.lit(False))).alias("inexact"),
    )
    rows = fields.where("kind IS NOT NULL").groupBy("column", "kind").agg(F.min("numeric").alias("numeric"), F.max("wide").alias("wide"), F.max("inexact").alias("inexact")).collect()
    by_column: dict[str, list] = {r.column: [] for r in values.select("column").distinct().collect()}
    for r in rows:
        by_column[r.column].append(r)
    types = {}
    for column, own in by_column.items():
        kinds = {r.kind for r in own}
        if "list" in kinds:
            types[column] = "array<string>"
        elif kinds == {"integer"}:
            types[column] = "decimal(38,0)" if any(r.wide for r in own) else "bigint"
        elif kinds == {"boolean"}:
            types[column] = "boolean"
        elif kinds and kinds != {"string"} and all(r.numeric and not r.inexact for r in own):
            types[column] = "double"
        else:
            types[column] = "string"
    return types


def unified(raw: DataFrame, drift: Drift | None = None) -> DataFrame:
    """One consistent table of all readable records, repeated lines once.

    Columns ``report_series, file_name, line_no, entry_id`` and one column for each column of the
    alias table, typed as ``column_types`` says (in a list column other values become lists of one). A column that has the name of an input column is called
    ``field_`` and its name. A number of more than 38 digits is a double, as Spark reads it.
    """
    drift = Drift(raw) if drift is None else drift
    aliases = cut(drift.aliases())
    within = (F.col("c.field") == F.col("a.field")) & (F.col("c.report_series") == F.col("a.report_series")) & F.col("c.idx").between(F.col("a.first_idx"), F.col("a.last_idx"))
    by_file = cut(drift.catalogue.alias("c").join(aliases.alias("a"), within).select("c.report_series", "c.file_name", "c.field", "a.column"))
    names = by_file.groupBy("report_series", "file_name").agg(F.map_from_entries(F.collect_list(F.struct("column", "field"))).alias("_names"))
    once = raw.where("report_series IS NOT NULL AND file_name IS NOT NULL").dropDuplicates(["report_series", "file_name", "line_no", "entry_id", "raw_record"])
    rows = parsed(once, lambda r: read_records(r).where("record IS NOT NULL").select("report_series", "file_name", "line_no", "entry_id", F.col("record").cast("map<string,variant>").alias("_values")))
    exploded = rows.select("report_series", "file_name", F.explode("_values").alias("field", "value"))
    types = column_types(exploded.join(broadcast_if_small(by_file), ["report_series", "file_name", "field"]).select("column", "value"))
    rows = rows.join(broadcast_if_small(names), ["report_series", "file_name"], "left")
    columns = []
    for column, kind in sorted(types.items()):
        value = F.try_element_at("_values", F.try_element_at("_names", F.lit(column)))
        if kind == "array<string>":
            v = F.when(kind_of(value) == "list", F.try_variant_get(value, "$", kind)).when(kind_of(value).isNotNull(), F.array(F.try_variant_get(value, "$", "string")))
        else:
            v = F.try_variant_get(value, "$", kind)
        columns.append(v.alias(column if column not in INPUT else f"field_{column}"))
    return rows.select("report_series", "file_name", "line_no", "entry_id", *columns)
