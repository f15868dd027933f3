"""Sources: splits, stored results, JSON in two shapes, run records, serving logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkroll.skew import rank_by_id

# The counters of a serving log line.
LOG_COUNTERS = {
    "generation_throughput": r"Avg generation throughput: ([0-9.]+) tokens/s",
    "running_reqs": r"Running: (\d+) reqs",
    "pending_reqs": r"Pending: (\d+) reqs",
    "gpu_kv_cache": r"GPU KV cache usage: ([0-9.]+)%",
    "cpu_kv_cache": r"CPU KV cache usage: ([0-9.]+)%",
}


def load_split(df: DataFrame, split: str, order: str, split_col: str = "split") -> DataFrame:
    """The rows of a named split with a dense 0-based row id in source order."""
    return rank_by_id(df.where(F.col(split_col) == split), order, "row_id")


def rename_fields(df: DataFrame, field_map: Mapping[str, str], remove_mapped: bool) -> DataFrame:
    """Columns under their new names, with or without the originals; unmapped columns pass."""
    if remove_mapped:
        return df.withColumnsRenamed(dict(field_map))
    return df.withColumns({new: F.col(old) for old, new in field_map.items()})


def load_results(spark: SparkSession, path: str, columns: Mapping[str, Column] | None = None) -> DataFrame:
    """Already generated results instead of a new generation."""
    stored = spark.read.parquet(path)
    return stored if columns is None else stored.select(*[c.alias(n) for n, c in columns.items()])


def explode_columnar(df: DataFrame, column: str, fields: Mapping[str, str], first: int | None = None) -> DataFrame:
    """A JSON object of parallel lists in each row, to one row per list position; the first N of each."""
    schema = ", ".join(f"{n} array<{t}>" for n, t in fields.items())
    parsed = df.withColumn("__j", F.from_json(column, schema))
    zipped = F.arrays_zip(*[F.col(f"__j.{n}") for n in fields])
    rows = parsed.select("*", F.posexplode(zipped).alias("pos", "__row")).select(*df.columns, F.col("pos").cast("bigint").alias("pos"), *[F.col(f"__row.{n}").alias(n) for n in fields]).drop(column)
    return rows if first is None else rows.where(F.col("pos") < first)


def read_columnar_json(spark: SparkSession, path: str, fields: Mapping[str, str], first: int | None = None) -> DataFrame:
    """Files that are one JSON object of parallel lists each."""
    return explode_columnar(spark.read.text(path, wholetext=True), "value", fields, first)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def parse_jsonl(lines: DataFrame, column: str, schema: str) -> DataFrame:
    return lines.select(F.from_json(column, schema).alias("r")).select("r.*")


def merge_shards(shards: Mapping[int, DataFrame]) -> DataFrame:
    """Per-process shards under one schema, in shard order by the `shard` column."""
    merged = None
    for number in sorted(shards):
        part = shards[number].withColumn("shard", F.lit(number).cast("bigint"))
        merged = part if merged is None else merged.unionByName(part)
    return merged


def resume_pending(requests: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose id has no stored result yet."""
    return requests.join(done.select(key), key, "left_anti")


def flatten_columns(df: DataFrame, dtype: T.DataType, path: Column, name: str, separator: str) -> list[Column]:
    """Leaf columns of a nested struct, named by their path; lists by index, as many as the longest list in the data has."""
    if isinstance(dtype, T.StructType):
        return [c for f in dtype.fields for c in flatten_columns(df, f.dataType, path.getField(f.name), f"{name}{separator}{f.name}", separator)]
    if isinstance(dtype, T.ArrayType):
        longest = df.agg(F.max(F.size(path))).first()[0] or 0
        return [c for i in range(longest) for c in flatten_columns(df, dtype.elementType, F.get(path, F.lit(i)), f"{name}{separator}{i}", separator)]
    return [path.alias(name)]


def flatten_run_records(df: DataFrame, config: str, summary: str) -> DataFrame:
    """Run config as `cfg__a.b` columns and run summary as `sum__a#b` columns next to the other columns."""
    flat = []
    for column, prefix, separator in ((config, "cfg__", "."), (summary, "sum__", "#")):
        for f in df.schema[column].dataType.fields:
            flat += flatten_columns(df, f.dataType, F.col(column).getField(f.name), f"{prefix}{f.name}", separator)
    return df.select(*[c for c in df.columns if c not in (config, summary)], *flat)


def _nesting(text: Column) -> Column:
    """How deep the containers of a JSON text are nested."""
    outside = F.regexp_replace(text, r'"(?:\\.|[^"\\])*+"', "")
    brackets = F.regexp_extract_all(outside, F.lit(r"[\[\]{}]"), F.lit(0))
    step = lambda state, b: F.struct(
        (state["now"] + F.when(b.isin("[", "{"), 1).otherwise(-1)).alias("now"),
        F.greatest(state["most"], state["now"] + F.when(b.isin("[", "{"), 1).otherwise(0)).alias("most"))
    return F.aggregate(brackets, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda state: state["most"])


def json_leaves(df: DataFrame, columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """The leaves of JSON texts without a declared schema: one row of (source, key, path, leaf) beside the other columns.

    `columns` maps a JSON column to its (prefix, separator). Rows may have any keys, of any kind and depth. Empty
    containers are leaves; a null or broken text has none. `leaf` is a VARIANT, `path` finds it again from the root.
    The texts are opened level by level, in one pass without a shuffle.
    """
    spark, names = df.sparkSession, list(columns)
    keys = [c for c in df.columns if c not in columns]
    deepest = df.agg(*[F.max(_nesting(F.col(c))).alias(c) for c in names]).first()
    roots = [F.struct(F.lit(c).alias("source"), F.lit("").alias("key"), F.lit("$").alias("path"), F.try_parse_json(c).alias("leaf")) for c in names]
    rows = df.select(*keys, F.inline(F.array(*roots)))
    is_root = F.col("key") == ""
    prefix = reduce(lambda rest, c: F.when(F.col("source") == c, columns[c][0]).otherwise(rest), names, F.lit(""))
    separator = reduce(lambda rest, c: F.when(F.col("source") == c, columns[c][1]).otherwise(rest), names, F.lit(""))
    for _ in range(max((d or 0 for d in deepest), default=0)):
        inner = spark.tvf.variant_explode_outer(F.col("leaf").outer()).toDF("__pos", "__name", "__inner")
        name = F.coalesce("__name", F.col("__pos").cast("string"))
        # a path takes either quote, but not both in one key
        quote = F.when(F.contains("__name", F.lit("'")), '"').otherwise("'")
        step = F.when(F.col("__name").isNull(), F.concat(F.lit("["), name, F.lit("]"))).otherwise(F.concat(F.lit("["), quote, "__name", quote, F.lit("]")))
        opened = F.col("__pos").isNotNull()
        rows = rows.lateralJoin(inner).select(
            *keys, "source",
            F.when(opened, F.concat(F.when(is_root, prefix).otherwise(F.concat("key", separator)), name)).otherwise(F.col("key")).alias("key"),
            F.when(opened, F.concat("path", step)).otherwise(F.col("path")).alias("path"),
            F.when(opened, F.col("__inner")).otherwise(F.col("leaf")).alias("leaf"))
    return rows.where(~is_root)


def flatten_json_records(df: DataFrame, config: str, summary: str) -> DataFrame:
    """As `flatten_run_records` for JSON texts whose keys differ from run to run.

    One job finds the keys of all runs with the type that fits all their values; the columns are then read by their
    paths, without a shuffle. Where runs disagree on the kind of a value, and for empty containers, the column is text.
    """
    leaves = json_leaves(df.select(config, summary), {config: ("cfg__", "."), summary: ("sum__", "#")})
    found = leaves.groupBy("source", "key", "path").agg(F.schema_of_variant_agg("leaf").alias("type")).orderBy("source", "key", "path").collect()
    by_name: dict[str, list[Column]] = {}
    for r in found:
        known = r["type"] in ("BIGINT", "DOUBLE", "BOOLEAN")
        kind = r["type"] if known else "DOUBLE" if r["type"].startswith("DECIMAL") else "STRING"
        value = F.try_variant_get(f"__{r['source']}", r["path"], kind)
        if kind == "STRING":  # a filled container of another run has columns of its own
            shape = F.schema_of_variant(F.try_variant_get(f"__{r['source']}", r["path"], "variant"))
            value = F.when(~shape.rlike("^(OBJECT<.+>|ARRAY<(?!VOID>).*)$"), value)
        by_name.setdefault(r["key"], []).append(value)
    # keys that hold the separator may fall together with a nested one
    flat = [(c[0] if len(c) == 1 else F.coalesce(*[x.cast("string") for x in c])).alias(name) for name, c in by_name.items()]
    parsed = df.withColumns({f"__{c}": F.try_parse_json(c) for c in (config, summary)})
    return parsed.select(*[c for c in df.columns if c not in (config, summary)], *flat)


def flatten_metrics(df: DataFrame, column: str, keys: Sequence[str], delimiter: str = "/") -> DataFrame:
    """Nested metrics as (key, value) rows, null as the text "None". Field names may hold the delimiter."""

    def leaves(dtype: T.DataType, path: Column, names: list[str]) -> list[Column]:
        if isinstance(dtype, T.StructType):
            return [c for f in dtype.fields for c in leaves(f.dataType, path.getField(f.name), [*names, f.name])]
        return [F.struct(F.lit(delimiter.join(names)).alias("key"), F.coalesce(path.cast("string"), F.lit("None")).alias("value"))]

    return df.select(*keys, F.inline(F.array(*leaves(df.schema[column].dataType, F.col(column), []))))


def server_log_stats(lines: DataFrame, line: str = "line") -> DataFrame:
    """Average of each counter over the lines that show it, 0.0 if none does."""
    found = {k: F.regexp_extract(line, p, 1).try_cast("double") for k, p in LOG_COUNTERS.items()}
    return lines.agg(*[F.coalesce(F.avg(v), F.lit(0.0)).alias(f"avg_{k}") for k, v in found.items()])


def total_throughput(stats: DataFrame, processes: int) -> DataFrame:
    """All stats to 2 decimals, with the throughput of all processes together."""
    total = F.round(F.col("avg_generation_throughput") * processes, 2).alias("total_generation_throughput")
    return stats.select(*[F.round(c, 2).alias(c) for c in stats.columns], total)


def synth_episodes(ids: DataFrame, key: str, seed: int, include_advantages: bool) -> DataFrame:
    """Seeded random episodes: 5 to 15 ids between 1 and 100 per side, a reward in [0, 10)."""

    def draw(purpose: str, *more: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), F.col(key), *more), F.lit(1_000_003))

    def token_list(purpose: str) -> Column:
        size = (draw(f"{purpose} length") % 11 + 5).cast("int")
        return F.transform(F.sequence(F.lit(1), size), lambda i: (draw(purpose, i) % 100 + 1).cast("int"))

    out = ids.select(key, token_list("query").alias("query_token_ids"), token_list("response").alias("response_token_ids"), (draw("reward") / 100_000.3).alias("reward"))
    return out.withColumn("advantages", F.array_repeat(F.lit(1.0), F.size("response_token_ids"))) if include_advantages else out
