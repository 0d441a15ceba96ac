"""Records of four layouts as preference groups: columns renamed, reasons for dropping rows, counts of them."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError
from ..functions.text import strip
from .order import with_index

#: Columns that each layout needs, and the names of winners.
REQUIRED = {"pairwise": ("prompt", "chosen", "rejected"), "pairwise_implicit": ("chosen", "rejected"), "kway": ("prompt", "responses"), "arena": ("prompt", "response_a", "response_b", "winner")}
WINNER_A = ("a", "model_a", "response_a", "0", "left")
WINNER_B = ("b", "model_b", "response_b", "1", "right")
TIE = ("tie", "draw", "both", "neither", "")
#: Layouts by other names, with the column that they need besides.
ALIASES = {"kway_ranking": ("kway", "ranking"), "kway_scores": ("kway", "scores")}


@dataclass(frozen=True)
class FieldMap:
    """The names that a table uses for the columns of the layouts."""

    prompt: str = "prompt"
    chosen: str = "chosen"
    rejected: str = "rejected"
    responses: str = "responses"
    ranking: str = "ranking"
    scores: str = "scores"
    response_a: str = "response_a"
    response_b: str = "response_b"
    winner: str = "winner"

    @classmethod
    def of(cls, names: dict[str, str] | None) -> FieldMap:
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(names or {}) - known):
            raise ConfigError(f"unknown fields {unknown}; known: {sorted(known)}")
        return cls(**(names or {}))


def validate_columns(df: DataFrame, layout: str, names: FieldMap) -> str:
    """The layout's own name; raises if a column that it needs is missing."""
    layout, extra = ALIASES.get(layout, (layout, None))
    if layout not in REQUIRED:
        raise ConfigError(f"unknown layout {layout!r}; known: {sorted(REQUIRED)}")
    need = [*REQUIRED[layout], *([extra] if extra else [])]
    if missing := [c for c in need if getattr(names, c) not in df.columns]:
        raise DataError(f"layout {layout} needs columns {missing}; there are {df.columns}")
    if layout == "kway" and names.ranking not in df.columns and names.scores not in df.columns:
        raise DataError("layout kway needs a column of rankings or of scores")
    return layout


def extract_slices(keys: list[str]) -> Column:
    """A map of the keys that are not null, as strings."""
    if not keys:
        return F.create_map().cast("map<string,string>")
    pairs = F.create_map(*(x for k in keys for x in (F.lit(k), F.col(k).cast("string"))))
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def number_list(df: DataFrame, column: str, kind: str) -> Column:
    """A list cast to int or double element by element; what cannot be cast is null inside."""
    element = dict(df.dtypes)[column].removeprefix("array<").removesuffix(">")
    cast = (lambda x: x.try_cast(kind)) if element == "string" else (lambda x: x.cast(kind))
    return F.transform(F.col(column), cast)


def to_groups(df: DataFrame, layout: str, names: FieldMap | None = None, slice_keys: list[str] | None = None) -> DataFrame:
    """All columns of df, and prompt, responses, ranking, scores, slices, reason (why a row is not a group; null if it is)."""
    names = names or FieldMap()
    layout = validate_columns(df, layout, names)
    none = F.lit(None)
    reason = none.cast("string")
    ranking, scores = none.cast("array<int>"), none.cast("array<double>")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    prompt = F.lit("") if layout == "pairwise_implicit" else text(names.prompt)
    if layout in ("pairwise", "pairwise_implicit"):
        responses = F.array(text(names.chosen), text(names.rejected))
        ranking = F.array(F.lit(0), F.lit(1))
        reason = F.when(F.col(names.chosen).isNull() | F.col(names.rejected).isNull(), "a side is null")
    elif layout == "arena":
        winner = F.lower(strip(text(names.winner)))
        a, b = text(names.response_a), text(names.response_b)
        responses = F.when(winner.isin(*WINNER_B), F.array(b, a)).otherwise(F.array(a, b))
        ranking = F.when(winner.isin(*WINNER_A, *WINNER_B), F.array(F.lit(0), F.lit(1)))
        reason = F.when(F.col(names.response_a).isNull() | F.col(names.response_b).isNull(), "a response is null").when(winner.isin(*TIE), "tie").when(ranking.isNull(), "the winner is none of the names known")
    else:
        responses = F.transform(F.col(names.responses), lambda x: F.coalesce(x.cast("string"), F.lit("")))
        reason = F.when(F.col(names.responses).isNull(), "no list of responses")
        if names.ranking in df.columns:
            ranking = number_list(df, names.ranking, "int")
            reason = F.coalesce(reason, F.when(F.exists(ranking, lambda x: x.isNull()), "a rank is no whole number"))
        if names.scores in df.columns:
            scores = number_list(df, names.scores, "double")
            reason = F.coalesce(reason, F.when(F.exists(scores, lambda x: x.isNull()), "a score is no number"))
    rows = df.select("*", prompt.alias("_prompt"), responses.alias("_responses"), ranking.alias("_ranking"), scores.alias("_scores"), extract_slices(slice_keys or []).alias("_slices"), reason.alias("_reason"))
    k, r, s = F.size("_responses"), F.col("_ranking"), F.col("_scores")
    invalid = (
        F.when(k < 2, "one response or none")
        .when(r.isNotNull() & (F.size(r) != k), "as many ranks as responses are needed")
        .when(F.exists(r, lambda x: x < 0), "a rank is below 0")
        .when(s.isNotNull() & (F.size(s) != k), "as many scores as responses are needed")
        .when(F.exists(s, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "a score is not finite")
    )
    new = ("prompt", "responses", "ranking", "scores", "slices")
    kept = [c for c in df.columns if c not in (*new, "reason")]
    return rows.select(*kept, *(F.col(f"_{c}").alias(c) for c in new), F.coalesce(F.col("_reason"), invalid).alias("reason"))


def load_report(groups: DataFrame) -> DataFrame:
    """reason (null: kept), rows, share of all rows."""
    counted = groups.groupBy("reason").agg(F.count("*").alias("n_rows"))
    total = counted.agg(F.sum("n_rows").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("reason", "n_rows", (F.col("n_rows") / F.col("total")).alias("share"))


def load_groups(df: DataFrame, layout: str, names: FieldMap | None = None, slice_keys: list[str] | None = None, max_drop_rate: float = 0.05, start_uid: int = 0, order: list[str] | None = None) -> DataFrame:
    """Groups with uid, by `order` and then by a hash of the row; raises if more than max_drop_rate of the rows are dropped, or all of them.

    So ids are the same in every run, also where prompts are equal or, as in pairwise_implicit, empty; equal rows have any of theirs.
    """
    groups = to_groups(df, layout, names, slice_keys)
    n, kept = groups.agg(F.count("*"), F.count_if(F.col("reason").isNull())).first()
    if not kept:
        raise DataError(f"none of {n} rows is a group")
    if (n - kept) / n > max_drop_rate:
        raise DataError(f"{n - kept} of {n} rows are dropped, more than {max_drop_rate}")
    out = groups.where(F.col("reason").isNull()).drop("reason")
    whole = F.xxhash64(F.to_json(F.struct(*out.columns)))
    return with_index(out.withColumn("_hash", whole), [*(order or ["prompt"]), "_hash"], "uid", start_uid).drop("_hash")
