"""Secret scans with corpus-wide ownership frequency.

A scan finds candidate spans in every text. The hash of each candidate value
is then counted over the whole corpus by distinct repositories and owners:
values found under many owners are widely copied examples, values of one
owner look live. Only DataFrame functions run here.

Spans. ``assign``, ``access`` and ``hex`` are the base kinds and always stay.
The method adds spans of kind ``token`` (vendor prefixes, private-key headers,
JSON web tokens): strings that only sometimes are secrets, and which count
where the corpus shows that their value is not a widely copied example.
Offsets are code points, the end exclusive. Spark has no function that gives
match positions, so a text is split by the pattern and the lengths of pieces
and matches are summed in order by a window over one text's matches.

Scale. Scanning is row by row. Only candidates (id, hash, owner) are shuffled,
never texts. Distinct owners are counted in two steps, (hash, repository,
owner) first, so a hot repository or a value copied into a third of all rows is
combined before the shuffle; verdicts are joined back by hash to the candidate
rows alone, a join that Spark may split where one hash is hot.

Defined results: null or empty text has no spans, an empty list's digest is that of
the empty string; a null owner or repository counts as one unknown owner;
repeated rows give equal results. Spans that begin alike come by kind as listed. A long text is
scanned whole in its row; ``redact`` looks back over a text's spans for each span, so its work
grows with the square of the spans of one text. Columns travel as one struct, so their names cannot
clash. Without candidates, or without rows, the results have the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolift.llm.common import saved, text_of

#: kind -> (pattern, group that holds the value, least length of that value).
#: Leftmost matches of a pattern do not overlap; short ones are dropped after matching.
BASE_KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # One run holds one match: asking for the length in the pattern finds the same spans.
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
ADDED_KINDS: dict[str, tuple[str, int, int]] = {
    "token": (r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}"
              r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|AIza[A-Za-z0-9_-]{30,}"
              r"|-----BEGIN [A-Z ]*PRIVATE KEY-----)", 0, 10),
}
KINDS = BASE_KINDS | ADDED_KINDS
ORDER = {kind: i for i, kind in enumerate(KINDS)}

#: A value found under at least this many distinct owners is a widely copied example.
EXAMPLE_OWNERS = 3

MATCHES = ("array<struct<rank:int,number:int,gap:int,length:int,value_length:int,value_hash:string>>")


def _matches(text: Column, kind: str) -> Column:
    """Matches of one kind in order: rank, number, length of the gap before, own length, value.

    The last entry is the rest of the text, with no length.
    """
    pattern, group, _ = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"), values.alias("value"))
    pieces = pieces.cast("array<struct<gap:string,match:string,value:string>>")
    listed = F.transform(pieces, lambda x, i: F.struct(
        F.lit(ORDER[kind]).alias("rank"), i.alias("number"), F.char_length(x["gap"]).alias("gap"),
        F.char_length(x["match"]).alias("length"), F.char_length(x["value"]).alias("value_length"),
        F.sha2(x["value"], 256).alias("value_hash")))
    # Most texts have no match; the passes above are made only where there is one.
    return F.when(text.rlike(pattern), F.filter(listed, lambda x: x["length"].isNotNull())).otherwise(F.array().cast(MATCHES))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "source",
         owner_col: str | None = None) -> DataFrame:
    """Every row's raw matches, saved: (_row, id, text_hash, repository, owner, matches).

    The one pass over the texts. ``owner_col`` defaults to the repository
    column (a repository is its own owner then).
    """
    unknown = F.lit("\u0000unknown")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("_text"),
        F.coalesce(F.col(f"`{repository_col}`").cast("string"), unknown).alias("repository"),
        F.coalesce(F.col(f"`{owner_col or repository_col}`").cast("string"), unknown).alias("owner"))
    matches = F.concat(*[_matches(F.col("_text"), k) for k in KINDS])
    # Row numbers are stable because the table is written before they are used.
    return saved(rows.select(F.monotonically_increasing_id().alias("_row"), "id", F.sha2("_text", 256).alias("text_hash"),
                             "repository", "owner", matches.cast(MATCHES).alias("matches")), "secret_matches")


def candidates(scanned: DataFrame) -> DataFrame:
    """One row per match that is long enough, with its offsets in code points."""
    each = scanned.where(F.size("matches") > 0).select("_row", "repository", "owner", F.inline("matches"))
    before = Window.partitionBy("_row", "rank").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(before).cast("int"))
    least = F.element_at(F.array(*[F.lit(least) for _, _, least in KINDS.values()]), F.col("rank") + 1)
    return each.where(F.col("value_length") >= least).select(
        "_row", "repository", "owner", (F.col("end") - F.col("length")).alias("start"), "rank", "end", "value_hash")


def ownership(candidates: DataFrame) -> DataFrame:
    """Per value hash: distinct owners and repositories, occurrences, and whether it is an example.

    ``candidates`` has (value_hash, repository, owner). Distinct pairs are
    formed first (combined on the map side), then counted, so no group is
    ever gathered in one task.
    """
    pairs = candidates.groupBy("value_hash", "repository", "owner").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("value_hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    # A repository belongs to one owner, so repositories of a value add up over its owners.
    return owners.groupBy("value_hash").agg(
        F.count("*").alias("n_owners"), F.sum("repos").alias("n_repositories"), F.sum("n").alias("n_found")) \
        .withColumn("example", F.col("n_owners") >= EXAMPLE_OWNERS)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "source",
                 owner_col: str | None = None) -> DataFrame:
    """One row per document row: id, text_hash, ``spans``.

    A span is (start, rank, kind, end, example, n_owners), by start, then
    kind as listed. Base kinds are always there; added kinds only where the
    corpus does not show the value as a widely copied example.
    """
    scanned = scan(docs, id_col, text_col, repository_col, owner_col)
    found = saved(candidates(scanned), "secret_candidates")
    owned = ownership(found.select("value_hash", "repository", "owner"))
    judged = found.join(owned.select("value_hash", "n_owners", "example"), "value_hash") \
        .where((F.col("rank") < len(BASE_KINDS)) | ~F.col("example"))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("rank") + 1)
    # One row per document again: only a document's own spans meet.
    per_row = judged.groupBy("_row").agg(F.sort_array(F.collect_list(
        F.struct("start", "rank", kind.alias("kind"), "end", "example", "n_owners"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,example:boolean,n_owners:bigint>>")
    return scanned.select("_row", "id", "text_hash").join(per_row, "_row", "left") \
        .select(F.col("id").alias(id_col), "text_hash", F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; overlapping spans become one mark.

    Each span gives the text between the furthest end so far and its start,
    so the pieces are joined once, whatever their number.
    """
    def before(i: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(F.slice(spans, 1, i), lambda s: s["end"])), F.lit(0))

    def piece(s: Column, i: Column) -> Column:
        at = F.when(i == 0, F.lit(0)).otherwise(before(i))
        return F.when(s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.lit(mark))).otherwise(F.lit(""))
    last = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
    return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, last + 1, F.length(text)))


def redact_live(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "source") -> DataFrame:
    """``docs`` with every owner-specific (live-looking) span cut out of the text.

    Widely copied examples stay. No document is dropped. A document's spans
    follow from its text alone, so the two meet on the text's hash.
    """
    spans = find_secrets(docs, id_col, text_col, repository_col)
    live = spans.select(F.col("text_hash").alias("_hash"), F.filter("spans", lambda s: ~s["example"]).alias("_live")) \
        .where(F.size("_live") > 0).dropDuplicates(["_hash"])
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = docs.select(own.alias("_doc"), F.sha2(text_of(text_col), 256).alias("_hash")).join(live, "_hash", "left")
    text = F.col("_doc")[text_col]
    new = F.when(F.col("_live").isNull(), text).otherwise(redact(text, F.col("_live"))).alias(text_col)
    return out.select(*[new if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns])
