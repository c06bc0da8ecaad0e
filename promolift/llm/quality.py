"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. What it measured and whether it
failed (one bit of ``rule_bits``) go to a ledger; a *policy* is a named,
versioned mask of the bits that reject. Applying another policy or counting
what each rule does alone (``ablation``) is bitwise work on the ledger, the
texts are not read again.

Only DataFrame functions run here. Every measurement is made inside the row
(arrays of the document's own words), so there is no shuffle at all, whatever
the number of documents, and a hot source means nothing. Repeated 3-word
windows are found by sorting the document's windows with their positions and
comparing neighbours: n log n in the words of one text, exact (words are
compared, not hashes).

Defined results: a null or empty text (or one of white space only) has no
words, all measurements 0, and fails the word-count rule. Rows are
independent, so ties and repeated rows give equal results; an empty table
gives an empty ledger. A long text costs arrays of its words and windows in its row. Extra columns stay out of the ledger but for the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolift.llm.common import SPACE, text_of

#: name -> failing condition over the measurements; the position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 60 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "few_letters": "2 * n_letter_words < n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}

#: version -> the rules that reject under it. Old versions stay.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(RULES),
}
MEASUREMENTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words"]


def policy_mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def _same(a: Column, b: Column) -> Column:
    return (a["w"] == b["w"]) & (a["w2"] == b["w2"]) & (a["w3"] == b["w3"])


def _repeat_words(words: str, windows: str) -> Column:
    """Words that lie in a 3-word window found twice or more (each word once).

    ``windows`` is the sorted array of (word, next, next but one, position).
    """
    repeated = F.filter(windows, lambda x, i: F.coalesce(_same(x, F.get(windows, i - 1)), F.lit(False))
                        | F.coalesce(_same(x, F.get(windows, i + 1)), F.lit(False)))
    covered = F.flatten(F.transform(repeated, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(F.size(F.array_distinct(covered))).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, the measurements and ``rule_bits`` (bit i: rule i failed)."""
    text = text_of(text_col)
    base = docs.select(F.col(id_col), text.alias("_text"))
    base = base.withColumn("_words", F.array_remove(F.split("_text", SPACE), ""))
    base = base.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("_words")
    windows = F.slice(F.arrays_zip(
        F.col("_words").alias("w"), F.slice("_words", 2, F.greatest(n, F.lit(1))).alias("w2"),
        F.slice("_words", 3, F.greatest(n, F.lit(1))).alias("w3"),
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))).alias("at")), 1, F.greatest(n - 2, F.lit(0)))
    names = "array<struct<w:string,w2:string,w3:string,at:int>>"
    base = base.withColumn("_windows", F.sort_array(windows.cast(names)))
    # One struct in an array of one, unpacked again: measurements are made once, and a
    # filter on them is not pushed down into a copy of all their expressions.
    measured = base.select(F.col(id_col), F.inline(F.array(F.struct(
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words("_words", "_windows").alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words")))))
    bits = F.lit(0)
    for name, failed in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(BIT[name])).otherwise(F.lit(0)))
    return measured.withColumn("rule_bits", bits.cast("long"))


def apply_policy(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy; no text is read."""
    base, mask = policy_mask("base"), policy_mask(policy) | policy_mask("base")
    return (entries.withColumn("base_failed", F.col("rule_bits").bitwiseAND(F.lit(base)) != 0)
            .withColumn("kept", F.col("rule_bits").bitwiseAND(F.lit(mask)) == 0))


def ablation(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: documents it fails, and those that only it rejects.

    The ledger is first summed to its distinct bit patterns (at most
    2^rules rows), so the per-rule counts never touch the documents again.
    """
    mask = policy_mask(policy)
    patterns = (entries.withColumn("_hit", F.col("rule_bits").bitwiseAND(F.lit(mask)))
                .groupBy("_hit").agg(F.count("*").alias("_n")))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]])
    per_rule = patterns.select("_hit", "_n", F.inline(rules))
    hit = F.col("_hit").bitwiseAND(F.col("bit")) != 0
    alone = F.col("_hit") == F.col("bit")
    return per_rule.groupBy("rule", "bit").agg(
        F.sum(F.when(hit, F.col("_n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("_n")).otherwise(0)).alias("n_only"))


def keep_good(docs: DataFrame, policy: str = "v1", id_col: str = "doc_id") -> DataFrame:
    """Documents that the policy keeps, with their own columns.

    The ledger is computed beside the row (same partition, no join): the
    document's columns travel in one struct.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(id_col), text_of("text").alias("text"))
    kept = apply_policy(ledger(packed, id_col), policy).where("kept")
    return kept.select(f"{id_col}.*")
