"""Typing, filtering and filling of station rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygauge.functions.text import clean_header

KEYS = ("date", "location")


def clean_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_header(c) for c in df.columns])


def to_double(col: Column | str) -> Column:
    """Number of a text cell; debris, blanks and NaN become null."""
    c = F.col(col) if isinstance(col, str) else col
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def convert_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast the named columns that exist, the keys excepted."""
    todo = [c for c in columns if c in df.columns and c not in KEYS]
    return df.withColumns({c: to_double(c) for c in todo})


def sentinel_to_null(df: DataFrame, cols: Sequence[str], sentinel: float = -9999.0) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in cols})


def drop_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns, ignoring those that are absent."""
    return df.drop(*cols)


def all_null(cols: Sequence[str]) -> Column:
    return F.coalesce(*[F.col(c) for c in cols]).isNull()


def remove_no_signal(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(how="all", subset=list(cols))


def drop_target_only(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Drop rows that have a target and no feature."""
    return df.filter(~(all_null(features) & F.col(target).isNotNull()))


def blank_predictions(df: DataFrame, features: Sequence[str], target: str, preds: Sequence[str]) -> DataFrame:
    """Null the predictions of rows that have a target and no feature."""
    mask = all_null(features) & F.col(target).isNotNull()
    return df.withColumns({p: F.when(~mask, F.col(p)) for p in preds})


def filter_train(df: DataFrame, year: int, target: str, nulls: str = "drop") -> DataFrame:
    """Rows after ``year``; null targets are dropped, set to 0 or kept."""
    out = df.filter(F.year("date") > year)
    if nulls == "drop":
        return out.dropna(subset=[target])
    return out.fillna(0.0, subset=[target]) if nulls == "impute" else out


def split_by_date(df: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    day = F.to_date(F.lit(cutoff))
    return df.filter(F.col("date") < day), df.filter(F.col("date") >= day)


def first_source(requests: DataFrame, sources: Sequence[tuple[str, DataFrame]], keys: Sequence[str] = ("location", "date")) -> DataFrame:
    """Rows of the first source that has the requested key, with the source's name.

    The sources meet first and are reduced to the requested keys at once.
    """
    keys = list(keys)
    parts = [df.withColumns({"feature_source": F.lit(name), "_prio": F.lit(i)}) for i, (name, df) in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    wanted = out.join(requests.select(*keys), keys, "left_semi")
    w = Window.partitionBy(*keys).orderBy("_prio")
    return wanted.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_prio")


def look_up(requests: DataFrame, sources: Sequence[tuple[str, DataFrame]], keys: Sequence[str] = ("location", "date")) -> DataFrame:
    """Every request once, with the row of its first source, or with a ``reason`` where no source has its key."""
    keys = list(keys)
    found = first_source(requests, sources, keys)
    out = requests.join(found, keys, "left")
    return out.withColumn("reason", F.when(F.col("feature_source").isNull(), "no source has these keys"))


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows ``column_name, n_null`` from one pass over the table."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.unpivot([], list(cols), "column_name", "n_null")


def stage_profile(stage: str, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Shape, null and infinite cells of a frame after a step."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0))
    infs = sum((F.count_if(F.abs(c) == float("inf")) for c in cols), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), nulls.alias("n_null"), infs.alias("n_inf")).select(
        F.lit(stage).alias("stage"), "n_rows", F.lit(len(df.columns)).alias("n_cols"), "n_null", "n_inf")


def missing_correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlation of the null flags of every two columns; null where a flag is constant."""
    from skygauge.operators.metrics import pair_corr

    flag = {c: F.col(c).isNull().cast("double") for c in cols}
    one = df.agg(*[pair_corr(flag[a], flag[b]).alias(f"{a}|{b}") for a in cols for b in cols])
    parts = F.split("pair", r"\|")
    return one.unpivot([], one.columns, "pair", "corr").select(
        parts[0].alias("a"), parts[1].alias("b"), "corr")


def validate_requests(df: DataFrame, numeric: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Split raw text requests into typed rows and rejects with a reason."""
    day = F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).cast("date")
    reason = (F.when(F.col("location").isNull() | (F.trim("location") == ""), "location required")
              .when(F.col("date").isNull(), "date required").when(day.isNull(), "date is not yyyy-MM-dd"))
    for c in numeric:
        reason = reason.when(F.col(c).isNull(), f"{c} required").when(to_double(c).isNull(), f"{c} is not a number")
    seen = df.withColumn("reason", reason)
    good = seen.filter("reason IS NULL").withColumns({"date": day, **{c: to_double(c) for c in numeric}}).drop("reason")
    return good, seen.filter("reason IS NOT NULL")
