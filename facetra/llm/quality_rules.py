"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once per document and stores the measurements and one failure bit per rule. A policy
is a versioned set of bits: ``apply_policy`` turns bits into verdicts with one bitwise AND, and ``ablations`` counts
what each rule alone removes from one pre-aggregated row per distinct bit pattern, without reading a text again.

Words are runs of characters other than space and U+0009-U+000D. Defined results for odd input:

* null text counts as the empty text: all measurements 0, the base rule fails;
* repeated rows and equal ids are judged row by row, so each input row gives one output row;
* columns of the input other than the id and the text pass through ``ledger`` unchanged; an input column with the name
  of a measurement is replaced by the measurement;
* an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetra.llm.common import fresh, let

SPACE = r"[ \x09-\x0D]+"
#: A repeated window is so many words long.
WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_repeat_words")

#: Rule name -> condition of failure over the measurements (SQL). The order fixes the bits; append only. Up to two repeated
#: lines are a refrain, a signature or a heading, which clean short texts have too; what repeats more must not exceed 30 %.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines",
    "word_length": "2 * word_chars < 5 * n_words OR word_chars > 12 * n_words",
    "shouting": "2 * n_upper > word_chars",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
#: The rules that no policy leaves out.
BASE = BITS["few_words"] | BITS["repeated_windows"]
POLICIES = {
    "v1": BASE | BITS["symbols"] | BITS["duplicate_lines"],
    "v2": sum(BITS.values()),
}
CURRENT = "v2"


def _covered(places: Column) -> Column:
    """Words under windows that start at the sorted places."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        places,
        start,
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).cast("long").alias("n"), x.alias("last")),
        lambda a: a["n"],
    )


def _repeated(words: Column) -> Column:
    """Words in windows that the text holds twice or more: sort (hash, place) and keep places whose neighbour is equal."""

    def places(s: Column) -> Column:
        last = F.size(s) - 1
        twice = F.filter(
            s,
            lambda e, j: ((j > 0) & (F.get(s, j - 1)["h"] == e["h"])) | ((j < last) & (F.get(s, j + 1)["h"] == e["h"])),
        )
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    def count(keys: Column) -> Column:
        pairs = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        some = let(pairs, lambda s: let(places(s), _covered))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(some)

    keys = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(keys, count))


def measurements(text: Column) -> Column:
    """A struct of all MEASURES of a text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))

    def of(w: Column) -> Column:
        return let(
            lines,
            lambda x: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
                _repeated(w).alias("n_repeat_words"),
            ),
        )

    return let(words, of)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all measurements and ``failure_bits`` (a bit per rule of RULES)."""
    others, m = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES and c != "failure_bits"], fresh(docs.columns, "measured")
    measured = docs.select(*others, measurements(F.col(f"`{text}`")).alias(m))
    flat = measured.select(*[F.col(f"`{c}`") for c in measured.columns if c != m], f"{m}.*")
    bits = [F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)) for name, rule in RULES.items()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return flat.withColumn("failure_bits", total.cast("long"))


def apply_policy(found: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds base_failed and kept; no text is read."""
    bits = F.col("failure_bits")
    return found.withColumns(
        {
            "base_failed": bits.bitwiseAND(F.lit(BASE)) != 0,
            "kept": bits.bitwiseAND(F.lit(POLICIES[policy] | BASE)) == 0,
        }
    )


def ablations(found: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it removes, and that stay if it is left out."""
    mask = POLICIES[policy] | BASE
    patterns = found.groupBy(F.col("failure_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BITS.items() if b & mask])
    each = patterns.select("bits", "n", F.inline(rules))
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        total(fails).alias("n_failed"), total(fails & rest).alias("n_only_this"), total(rest).alias("n_kept_without")
    )
