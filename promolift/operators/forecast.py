"""Forecast cleaning, matching forecasts to promoted articles, forecast statistics.

Matching rule: a forecast belongs to an article when its Description contains
the article text (case-sensitive); the first forecast in load order wins; only
promo rows get it; daily forecast = quantity / duration days.

Plans (all exact; descriptions that repeat are first made one row, with the
first of their forecasts):

* ``contains`` (default): articles of up to ``GRAM`` characters are looked up among the
  pieces of that length of the descriptions, of which each is one row with its first
  forecast before anything is joined. Longer articles are represented by
  their rarest piece of ``GRAM`` characters (pieces are counted over all descriptions;
  an article with a piece that is in none matches nothing): descriptions meet only
  the articles whose rarest piece they hold, and ``contains`` decides.
* ``token``: whitespace tokens of the description equal to the article, again one
  row for each token before the join.
* ``regex``: articles without a sign that means something in a pattern go the
  ``contains`` way (the same result). From every pattern the longest piece that
  each of its matches must contain is taken; descriptions meet it as they meet an article, and the pattern
  decides. Only patterns without such a piece are searched for in all descriptions, in batches.

The per-article winner is ``min_by(..., row_order)``, a partial aggregate, so
an article found in many descriptions is combined map-side.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolift import schema as S
from promolift.functions import clean as C

# Broadcast the article side (or the per-article match table) only under this
# many bytes, computed from a counted bound, never from a planner estimate
# (the estimate of an exploded side ignores the explosion).
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
_ROW_OVERHEAD = 48  # bytes per row on top of the text, generous


# ---------------------------------------------------------------- cleaning

# Header patterns per target, tried in this order; a header
# (lower-cased, without blanks, underscores, dashes and dots) maps to the
# first target one of whose patterns it contains; each target is used once.
HEADER_PATTERNS = [
    (S.DESCRIPTION, ["description", "desc", "item description"]),
    (S.START_DATE, ["date", "startdate", "promodate", "start date"]),
    (S.END_DATE, ["end", "enddate", "todate", "end date"]),
    (S.FORECAST_QTY, ["ttlforecastqty", "forecastqty", "totalforecast", "fcstqty",
                      "revisedttlfcstqty", "ttl forecast qty"]),
]


def normalise_header(name: str) -> str:
    """A header without outer blanks and without dots; of a run of blanks half are left (the odd one too)."""
    inside = (c for c in name.strip() if c != ".")
    runs = ((blank, list(run)) for blank, run in groupby(inside, key=" ".__eq__))
    return "".join(" " * -(-len(run) // 2) if blank else "".join(run) for blank, run in runs)


# What pattern search ignores in a header.
_IGNORED = str.maketrans("", "", " _-.")


def _target_order(header: str) -> list[str]:
    """Targets one of whose patterns the header contains, in the fixed order."""
    text = header.lower().translate(_IGNORED)
    return [target for target, patterns in HEADER_PATTERNS if any(p.translate(_IGNORED) in text for p in patterns)]


def header_mapping(columns: list[str]) -> dict[str, str]:
    """Old header -> target name (names only, no data).

    Headers choose in file order; each takes the first of its targets that is still free.
    """
    taken: dict[str, str] = {}  # target -> header
    for header in columns:
        free = next((t for t in _target_order(header) if t not in taken), None)
        if free is not None:
            taken[free] = header
    return {header: target for target, header in taken.items()}


def map_headers(raw: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rename forecast headers to the targets; ``mapping`` (from normalised headers) overrides the search."""
    df = raw.toDF(*map(normalise_header, raw.columns))
    chosen = header_mapping(df.columns) if mapping is None else mapping
    return df.select(*[F.col(f"`{c}`").alias(chosen.get(c, c)) for c in df.columns])


def missing_forecast_columns(df: DataFrame) -> list[str]:
    return [c for c in S.REQUIRED_FORECAST if c not in df.columns]


def clean_forecast(raw: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Mapped headers, parsed dates, Duration_Days, numeric quantity; bad rows dropped.

    End_Date is the start date when the file has no end column. Duration is
    end - start + 1, or 1 when a date is missing.
    """
    df = map_headers(raw, mapping)
    missing = missing_forecast_columns(df)
    if missing:
        raise ValueError(f"missing required forecast columns: {missing}")
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    start = C.to_date_any(F.col(S.START_DATE), types[S.START_DATE])
    end = C.to_date_any(F.col(S.END_DATE), types[S.END_DATE]) if S.END_DATE in df.columns else start
    df = df.withColumns({
        S.START_DATE: start,
        S.END_DATE: end,
        S.FORECAST_QTY: C.num_or_null(F.col(S.FORECAST_QTY), types[S.FORECAST_QTY]),
    })
    df = df.withColumn(S.DURATION_DAYS, F.coalesce(F.datediff(S.END_DATE, S.START_DATE) + 1, F.lit(1)).cast("int"))
    if S.ROW_ORDER not in df.columns:
        from promolift.sources.csv import with_load_order
        df = with_load_order(df)
    return df.dropna(subset=[S.START_DATE, S.FORECAST_QTY])


# ---------------------------------------------------------------- matching


def _first(df: DataFrame, *keys: str) -> DataFrame:
    """The first forecast in load order of each key.

    The load order is unique per forecast, so three scalar aggregates pick the same
    one, and keep fixed-width buffers (a hash aggregate with a map-side part).
    """
    return df.groupBy(*keys).agg(F.min_by("_qty", "_order").alias("_qty"), F.min_by("_daily", "_order").alias("_daily"),
                                 F.min("_order").alias("_order"))


def _descriptions(fc: DataFrame) -> DataFrame:
    """Each different description with its first forecast."""
    return _first(fc.select(
        F.col(S.DESCRIPTION).alias("_desc"),
        F.col(S.ROW_ORDER).alias("_order"),
        F.col(S.FORECAST_QTY).alias("_qty"),
        F.try_divide(F.col(S.FORECAST_QTY), F.col(S.DURATION_DAYS)).alias("_daily"),
    ).where(F.col("_desc").isNotNull()), "_desc")


# Characters of the pieces by which long articles are found.
GRAM = 4


def _grams(text, size):
    """The different pieces of ``size`` characters of a text; a shorter text is its own piece."""
    last = F.greatest(F.length(text) - size + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda at: F.substring(text, at, size)))


def _with_grams(desc: DataFrame, sizes: list[int]) -> DataFrame:
    """Descriptions once for each of their pieces of the given sizes (``_key``)."""
    pieces = F.flatten(F.transform(F.array(*[F.lit(n) for n in sizes]), lambda n: _grams(F.col("_desc"), n)))
    return desc.withColumn("_key", F.explode(F.array_distinct(pieces)))


@dataclass(frozen=True)
class _Texts:
    """What one small job finds out about a table of texts to look for (``_text``)."""
    n: int
    lengths: list[int]
    longest: int  # bytes

    @property
    def small(self) -> bool:
        """Whether the texts, and one row for each of their pieces, are proven small enough to broadcast."""
        return _bounded_bytes(self.n * max(1, self.longest), self.longest + 4 * GRAM) <= BROADCAST_MAX_BYTES

    @staticmethod
    def aggregates(text, name: str) -> list:
        return [F.count(text).alias(f"{name}_n"), F.array_sort(F.collect_set(F.length(text))).alias(f"{name}_lengths"),
                F.coalesce(F.max(F.octet_length(text)), F.lit(0)).alias(f"{name}_longest")]

    @staticmethod
    def of(row, name: str) -> _Texts:
        return _Texts(int(row[f"{name}_n"]), list(row[f"{name}_lengths"]), int(row[f"{name}_longest"]))


def _bounded_bytes(n: int, longest: int, extra: int = 0) -> int:
    return n * (longest + _ROW_OVERHEAD + extra)


def _seeds(desc: DataFrame, texts: DataFrame, known: _Texts) -> DataFrame:
    """(_text, _key): each text with its rarest piece; texts with a piece that no description holds are left out."""
    pieces = texts.select("_text", F.explode(_grams(F.col("_text"), F.least(F.length("_text"), F.lit(GRAM)))).alias("_key"))
    sizes = sorted({min(n, GRAM) for n in known.lengths})
    in_desc = _with_grams(desc.select("_desc"), sizes).select("_key")
    if known.small:  # only pieces of a text are counted
        in_desc = in_desc.join(F.broadcast(pieces.select("_key").distinct()), "_key", "left_semi")
    counts = in_desc.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    found = pieces.join(counts, "_key", "left")
    return (found.groupBy("_text")
            .agg(F.min(F.struct("_n", "_key")).alias("_rarest"), F.count(F.lit(1)).alias("_all"), F.count("_n").alias("_held"))
            .where(F.col("_held") == F.col("_all")).select("_text", F.col("_rarest._key").alias("_key")))


def _containing(desc: DataFrame, texts: DataFrame, known: _Texts) -> DataFrame:
    """Pairs of a text and a description that contains it."""
    seeds = _seeds(desc, texts, known)
    pieces = _with_grams(desc, sorted({min(n, GRAM) for n in known.lengths}))
    # A large text side: keep the exploded descriptions out of any broadcast.
    met = pieces.join(F.broadcast(seeds), "_key") if known.small else pieces.hint("merge").join(seeds, "_key")
    return met.where(F.contains("_desc", "_text")).drop("_key")


def _equal(keyed: DataFrame, texts: DataFrame, known: _Texts) -> DataFrame:
    """Texts equal to a key of the descriptions; a key is one row, however many descriptions hold it."""
    keys = _first(keyed, "_key")
    texts = texts.withColumn("_key", F.col("_text"))
    return keys.join(F.broadcast(texts), "_key") if known.small else keys.hint("merge").join(texts, "_key")


def promo_articles(sales: DataFrame) -> DataFrame:
    """Distinct promoted articles: a small table, combined on the map side."""
    return sales.where(S.is_promo() & F.col(S.ARTICLE).isNotNull()).select(S.ARTICLE).distinct()


def saved_articles(sales: DataFrame) -> DataFrame:
    """``promo_articles`` written to the work folder: the sales are read once for it, whatever follows."""
    from promolift.sources.store import saved_rows
    return saved_rows(promo_articles(sales), "promo_articles")


def forecast_match(articles: DataFrame, fc: DataFrame, mode: str = "contains") -> DataFrame:
    """Article, Forecast_Qty, Forecast_Daily_Qty, forecast_order: the first forecast per article.

    ``articles`` is a table of distinct articles, or sales, whose promoted
    articles are saved first. Count and text lengths come from one small job over that table.
    """
    return _match(saved_articles(articles) if S.STATUS in articles.columns else articles, fc, mode)[0]


# Characters that mean something in a pattern; an article without them matches literally.
PATTERN_SIGNS = r"[\\.^$|?*+()\[\]{}]"

# A pattern cut into escapes, classes, groups without groups in them, quantifiers and characters.
_PATTERN_TOKEN = (r"\\[\s\S]|\[(?:\\.|\[[^\]]*\]|[^\]\\])*\]|\((?:\\.|[^()\\])*\)"
                  r"|(?:[*+?]|\{\d+(?:,\d*)?\})[?+]?|[\s\S]")
# What is not taken apart: escapes of more than one character, quoting, flags.
_PATTERN_HARD = r"\\[^\W_dDwWsSbBhHvVRtnrfAzZG]|\(\?[a-zA-Z-]+[:)]"


def required_piece(pattern):
    """The longest piece that every match of a pattern must contain; NULL if none is found.

    Runs of plain characters and escaped signs are taken. A character that may be left out
    (``?``, ``*``, ``{0,``) ends the run before it; other quantifiers, classes, groups, anchors and
    escapes end it after the last character. Patterns with alternatives outside groups, groups in
    groups, flags or quoting give none.
    """
    tokens = F.regexp_extract_all(pattern, F.lit(_PATTERN_TOKEN), F.lit(0))
    nothing = F.lit("")

    def longer(a, b):
        return F.when(F.length(b) > F.length(a), b).otherwise(a)

    def step(state, token):
        run, best = state["run"], state["best"]
        escaped, plain = token.rlike(r"^\\[\W_]$"), ~token.rlike(PATTERN_SIGNS)
        optional = token.rlike(r"^(?:[*?]|\{0)")
        ended = F.when(optional, F.substring(run, F.lit(1), F.greatest(F.length(run) - 1, F.lit(0)))).otherwise(run)
        return F.when(escaped | plain, F.struct(F.concat(run, F.substring(token, F.length(token), F.lit(1))).alias("run"), best.alias("best"))) \
            .otherwise(F.struct(nothing.alias("run"), longer(best, ended).alias("best")))
    found = F.aggregate(tokens, F.struct(nothing.alias("run"), nothing.alias("best")), step, lambda s: longer(s["best"], s["run"]))
    hard = pattern.rlike(_PATTERN_HARD) | F.exists(tokens, lambda t: t.isin("(", ")", "[", "]", "{", "}", "|"))
    return F.when(~hard & (F.length(found) > 0), found)


PATTERN_BATCH, PATTERN_SALTS = 256, 64


def _searched(desc: DataFrame, patterns: DataFrame, n: int) -> DataFrame:
    """Pairs where the description matches the pattern (``_text``): the way for ``n`` patterns without a required piece.

    The patterns are gathered into arrays of about ``PATTERN_BATCH``, so a description is searched by one
    batch of patterns in one row and only the hits become rows; descriptions and batches meet by an
    equi-join on the batch number.
    """
    batches = max(1, -(-n // PATTERN_BATCH))
    numbered = patterns.select("_text", F.pmod(F.xxhash64("_text"), F.lit(batches)).alias("_batch"))
    gathered = numbered.groupBy("_batch").agg(F.collect_list("_text").alias("_patterns"))
    # Salted on both sides: with few batches, descriptions still spread over many tasks.
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))
    spread = desc.withColumn("_salt", F.pmod(F.xxhash64("_desc", "_order"), F.lit(PATTERN_SALTS))) \
        .withColumn("_batch", F.explode(numbers))
    salted = gathered.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PATTERN_SALTS - 1).cast("long"))))
    hits = F.filter("_patterns", lambda p: F.regexp(F.col("_desc"), p))
    return spread.join(salted, ["_batch", "_salt"]).select(F.explode(hits).alias("_text"), "_order", "_qty", "_daily")


def _match(articles: DataFrame, fc: DataFrame, mode: str) -> tuple[DataFrame, bool]:
    """The match table, and whether it (one row per article) is proven small enough to broadcast."""
    if mode not in ("contains", "token", "regex"):
        raise ValueError(f"unknown match mode {mode!r}")
    desc = _descriptions(fc)
    is_pattern = F.col("_text").rlike(PATTERN_SIGNS) if mode == "regex" else F.lit(False)
    texts = articles.select(F.col(S.ARTICLE).alias("_text")).withColumn(
        "_piece", F.when(is_pattern, required_piece(F.col("_text"))) if mode == "regex" else F.lit(None).cast("string"))
    short = ~is_pattern & ((F.length("_text") <= GRAM) | F.lit(mode == "token"))
    groups = {"equal": short, "long": ~is_pattern & ~short, "piece": F.col("_piece").isNotNull(),
              "bare": is_pattern & F.col("_piece").isNull()}
    looked_for = {k: F.when(c, F.col("_piece") if k == "piece" else F.col("_text")) for k, c in groups.items()}
    row = texts.agg(*[a for k, c in looked_for.items() for a in _Texts.aggregates(c, k)],
                    *_Texts.aggregates(F.col("_text"), "every")).first()  # counts and a few lengths, in one small job
    known = {k: _Texts.of(row, k) for k in (*groups, "every")}
    columns = ["_text", "_order", "_qty", "_daily"]
    parts = []
    if known["equal"].n:
        words = F.split(F.col("_desc"), r"\s+")
        keyed = desc.withColumn("_key", F.explode(F.array_distinct(words))) if mode == "token" \
            else _with_grams(desc, known["equal"].lengths)
        parts.append(_equal(keyed, texts.where(groups["equal"]).select("_text"), known["equal"]))
    if known["long"].n:
        parts.append(_containing(desc, texts.where(groups["long"]).select("_text"), known["long"]))
    if known["piece"].n:
        patterns = texts.where(groups["piece"]).select(F.col("_text").alias("_pattern"), F.col("_piece").alias("_text"))
        pairs = _containing(desc, patterns.select("_text").distinct(), known["piece"])
        met = pairs.join(F.broadcast(patterns) if known["every"].small else patterns, "_text")
        parts.append(met.where(F.regexp("_desc", F.col("_pattern"))).withColumn("_text", F.col("_pattern")))
    if known["bare"].n:
        parts.append(_searched(desc, texts.where(groups["bare"]).select("_text"), known["bare"].n))
    pairs = reduce(DataFrame.unionByName, [p.select(*columns) for p in parts]) if parts \
        else desc.withColumn("_text", F.lit(None).cast("string")).where(F.lit(False)).select(*columns)
    out = _first(pairs, "_text").select(F.col("_text").alias(S.ARTICLE), F.col("_qty").alias(S.FORECAST_QTY),
                                        F.col("_daily").alias(S.FORECAST_DAILY), F.col("_order").alias("forecast_order"))
    return out, _bounded_bytes(known["every"].n, known["every"].longest, extra=64) <= BROADCAST_MAX_BYTES


def no_forecast(sales: DataFrame) -> DataFrame:
    """Empty forecast columns, for data without forecasts."""
    return sales.withColumns({
        S.HAS_FORECAST: F.lit(False),
        S.FORECAST_QTY: F.lit(None).cast(T.DoubleType()),
        S.FORECAST_DAILY: F.lit(None).cast(T.DoubleType()),
    })


def attach_forecast(sales: DataFrame, fc: DataFrame | None, mode: str = "contains") -> DataFrame:
    """Sales plus Has_Forecast, Forecast_Qty, Forecast_Daily_Qty (promo rows only).

    The match table has one row per article; the left join to the sales rows
    is broadcast by AQE when small, else shuffled with skew splitting.
    """
    base = sales.drop(S.HAS_FORECAST, S.FORECAST_QTY, S.FORECAST_DAILY)
    if fc is None:
        return no_forecast(base)
    m, small = _match(saved_articles(base), fc, mode)
    m = m.withColumnRenamed(S.ARTICLE, "_m_article")
    # One row per promoted article: broadcast under the counted bound, else a
    # shuffle join (AQE splits a hot article on the sales side).
    joined = base.join(F.broadcast(m) if small else m, base[S.ARTICLE] == m["_m_article"], "left")
    promo = S.is_promo()
    matched = F.col("_m_article").isNotNull()
    return joined.select(
        *[base[c] for c in base.columns],
        (promo & matched).alias(S.HAS_FORECAST),
        F.when(promo & matched, F.col(S.FORECAST_QTY)).alias(S.FORECAST_QTY),
        F.when(promo & matched, F.col(S.FORECAST_DAILY)).alias(S.FORECAST_DAILY),
    )


def prepare(sales: DataFrame, fc: DataFrame | None = None, mode: str = "contains") -> DataFrame:
    """Analysis table: valid dates only, Year, Month, trimmed Article, forecast columns."""
    df = sales.where(F.col(S.SALES_DATE).isNotNull()).withColumns({
        S.YEAR: F.year(S.SALES_DATE),
        S.MONTH: F.month(S.SALES_DATE),
        S.ARTICLE: C.article_text(F.col(S.ARTICLE)),
    })
    return attach_forecast(df, fc, mode)


def forecast_stats(fc: DataFrame) -> DataFrame:
    """One row: forecasts, distinct descriptions, start-date range, mean and total quantity."""
    return fc.agg(F.count(F.lit(1)).alias("total_forecasts"),
                  F.countDistinct(S.DESCRIPTION).alias("unique_descriptions"),
                  F.min(S.START_DATE).alias("min_start_date"),
                  F.max(S.START_DATE).alias("max_start_date"),
                  C.exact_avg(S.FORECAST_QTY).alias("avg_forecast_qty"),
                  C.exact_sum(S.FORECAST_QTY).alias("total_forecast_qty"))


def load_forecasts(spark, paths, mapping: dict[str, str] | None = None):
    """Forecast files with free-form headers: mapped, cleaned, unioned, duplicates dropped.

    Files are grouped by header (one read per distinct header); a group that
    lacks a required column after mapping is skipped and reported. Columns
    beyond the mapped ones stay (NULL where a file lacks them). Among
    rows alike in every column the first in load order is kept. Returns (forecasts, rejected files).
    """
    from promolift.operators.ingest import dedup_rows
    from promolift.sources import csv as CSV
    files = CSV.list_files(spark, paths)
    if not files:
        return None, spark.createDataFrame([], "file string, missing string")
    headers = CSV.header_table(spark, files)
    groups = CSV.header_groups(spark, files, headers)
    missing = {}
    for header in groups:
        norm = [normalise_header(h) for h in header]
        m = header_mapping(norm) if mapping is None else mapping
        missing[header] = [c for c in S.REQUIRED_FORECAST if c not in [m.get(h, h) for h in norm]]
    parts = [clean_forecast(CSV.with_load_order(CSV.scan_csv(spark, members)), mapping)
             for header, members in groups.items() if not missing[header]]
    rej = CSV.rejected_files(spark, headers, groups, missing)
    if not parts:
        return None, rej
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return dedup_rows(out, S.ROW_ORDER), rej
