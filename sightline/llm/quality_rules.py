"""Quality rules: divergence of a document's histograms from language references. SQL functions only.

Base rules count words, symbols, repeated lines and repeated word windows. The verdict compares
two histograms of the whole text, character classes and common words, with references of
each language by Jensen-Shannon distance (0 to 1) and takes the nearest language.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \x09-\x0D]+"
EDGES = " \t\n\x0b\x0c\r"
WINDOW = 5
#: Common words of each language.
COMMON_WORDS = (
    "the of and to in that is for it with",
    "der die und den das von zu mit nicht ist",
    "de la le et les des en un que est",
    "que el en y los del las por con para",
)
WORDS = sorted({w for line in COMMON_WORDS for w in line.split()})
#: Character classes in the order in which they are taken out of the words; white space and the rest are two more.
CLASSES = (r"[a-z]+", r"\p{Ll}+", r"\p{Lu}+", r"[.,;:!?'\"()-]+", r"\p{N}+", r"\p{L}+")
#: A reference document has at most one symbol in so many characters.
FEW_SYMBOLS = 50
SYMBOLS = r"[#*$%&|<>]+"


@dataclass(frozen=True)
class Guards:
    """A histogram decides only from this length on, and rejects beyond this distance."""

    min_chars: int = 100
    min_words: int = 100
    class_distance: float = 0.3
    word_distance: float = 0.28


def measured(docs: DataFrame, text: str = "text", windows: bool = True) -> tuple[DataFrame, str]:
    """All columns and rows, with counts and both histograms in columns of a free prefix; and the prefix.

    A null text counts as empty. Every step is a column of its own, so that no step is worked
    out twice. Without `windows` the repeated words are left out.
    """
    p = free_prefix(docs)
    kept, c = list(docs.columns), lambda name: F.col(f"{p}{name}")

    def step(df: DataFrame, keep: str, **made: Column) -> DataFrame:
        return df.select(*[F.col(f"`{x}`") for x in kept], *[c(x) for x in keep.split()], *[v.alias(p + k) for k, v in made.items()])

    df = step(docs, "", text=F.coalesce(F.col(f"`{text}`"), F.lit("")))
    spaced = c("text")
    for x in EDGES[1:]:
        spaced = F.replace(spaced, F.lit(x), F.lit(" "))
    df = step(df, "text", words=F.array_remove(F.split(spaced, " "), ""), lines=F.filter(F.split(c("text"), "\n"), lambda x: F.length(F.btrim(x, F.lit(EDGES))) > 0))
    w = c("words")
    df = step(
        df, "words",
        n_words=F.size(w).cast("long"),
        n_chars=F.length(c("text")).cast("long"),
        n_lines=F.size(c("lines")),
        n_dup_lines=(F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
        common=F.concat(F.lit(" "), F.array_join(F.filter(w, lambda x: x.isin(*WORDS)), "  "), F.lit(" ")),
        joined=F.array_join(w, ""),
        **({"hashed": F.transform(w, lambda x: F.xxhash64(x))} if windows else {}),
    )
    done = "n_words n_chars n_lines n_dup_lines"
    common = F.array(*[((F.length(c("common")) - F.length(F.replace(c("common"), F.lit(f" {x} "), F.lit("")))) / (len(x) + 2)).cast("int") for x in WORDS])
    df = step(df, done + " hashed" * windows, common=common, word_chars=F.length(c("joined")).cast("long"), rest=F.regexp_replace(c("joined"), CLASSES[0], ""))
    done += " common word_chars"
    df = step(df, done + " rest" + " hashed" * windows, class0=c("word_chars") - F.length(c("rest")), n_symbols=(F.length(c("rest")) - F.length(F.regexp_replace(c("rest"), SYMBOLS, ""))).cast("long"))
    done += " class0 n_symbols"
    for i, pattern in enumerate(CLASSES[1:], 1):
        df = step(df, done + " hashed" * windows, before=F.length(c("rest")), rest=F.regexp_replace(c("rest"), pattern, ""))
        df = step(df, done + " rest" + " hashed" * windows, **{f"class{i}": c("before") - F.length(c("rest"))})
        done += f" class{i}"
    classes = F.array(*[c(f"class{i}").cast("long") for i in range(len(CLASSES))], c("n_chars") - c("word_chars"), F.length(c("rest")).cast("long"))
    done = "n_words n_chars n_lines n_dup_lines common word_chars n_symbols"
    df = step(df, done + " hashed" * windows, classes=classes)
    done += " classes"
    if not windows:
        return df, p
    # Digests of two, four and five words, each put together from shorter ones.
    for made, left, right, apart in (("two", "hashed", "hashed", 1), ("four", "two", "two", 2), ("five", "four", "hashed", WINDOW - 1)):
        n = F.greatest(F.size(c("hashed")) - apart if left == "hashed" else F.size(c("hashed")) - (3 if made == "four" else WINDOW - 1), F.lit(0))
        digests = F.zip_with(F.slice(c(left), F.lit(1), n), F.slice(c(right), F.lit(apart + 1), n), lambda a, b: F.xxhash64(a, b))
        df = step(df, done + " hashed", **{made: digests})
    # Windows in the order of their digests; only where one occurs twice.
    order = F.when(F.size(c("five")) == F.size(F.array_distinct(c("five"))), None).otherwise(F.sort_array(F.transform(c("five"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = step(df, done, order=order)
    same = lambda k, other: F.coalesce(F.get(c("order"), k)["h"] == F.get(c("order"), other)["h"], F.lit(False))
    places = F.transform(c("order"), lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["i"]))
    df = step(df, done, places=F.sort_array(F.filter(places, lambda x: x.isNotNull())))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(c("places"), start, lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    return step(df, done, n_repeat_words=F.coalesce(covered, F.lit(0)).cast("long")), p


def free_prefix(docs: DataFrame) -> str:
    """One that no column starts with."""
    p = "q_"
    while any(c.lower().startswith(p) for c in docs.columns):
        p = "_" + p
    return p


def shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / total)


def histograms(p: str) -> tuple[Column, Column]:
    """Shares of the character classes, and of the common words with all other words as the last bin."""
    n, common = F.col(f"{p}n_words"), F.col(f"{p}common")
    words = F.concat(common.cast("array<bigint>"), F.array(n - F.aggregate(common, F.lit(0).cast("bigint"), lambda a, x: a + x)))
    return shares(F.col(f"{p}classes"), F.col(f"{p}n_chars")), shares(words, n)


def base_failed(p: str) -> Column:
    n = F.col(f"{p}n_words")
    return (n < 10) | (100 * F.col(f"{p}n_repeat_words") > 20 * n)


def references(docs: DataFrame, text: str = "text", lang: str = "lang", guards: Guards = Guards()) -> list[tuple[list[float], list[float]]]:
    """Mean histograms of each language over all documents that are long enough and have few symbols.

    One row per language comes to the driver. No such documents give no reference.
    """
    df = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where(F.col("lang").isNotNull())
    df, p = measured(df, windows=False)
    n_chars = F.col(f"{p}n_chars")
    good = (n_chars >= guards.min_chars) & (F.col(f"{p}n_words") >= guards.min_words) & (FEW_SYMBOLS * F.col(f"{p}n_symbols") <= n_chars)
    classes, words = histograms(p)
    # Not a filter: the optimizer would move it below all steps and work each of them out again for it.
    df = df.select("lang", F.when(good, classes).alias("classes"), F.when(good, words).alias("words"))
    means = lambda name, n: F.array(*[F.avg(F.get(name, F.lit(i))) for i in range(n)]).alias(name)
    rows = df.groupBy("lang").agg(means("classes", len(CLASSES) + 2), means("words", len(WORDS) + 1)).collect()
    return [(list(r["classes"]), list(r["words"])) for r in sorted(rows) if r["classes"][0] is not None]


def jensen_shannon(p: Column, reference: list[float]) -> Column:
    """Square root of the divergence in bits between two histograms."""
    q = F.array(*[F.lit(float(x)) for x in reference])
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    bits = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(bits / 2, F.lit(0.0)))


def nearest(p: Column, all_: list[list[float]]) -> Column:
    distances = [jensen_shannon(p, r) for r in all_]
    return reduce(lambda a, b: F.least(a, b), distances) if distances else F.lit(None).cast("double")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, refs: list[tuple[list[float], list[float]]], text: str = "text", guards: Guards = Guards()) -> tuple[DataFrame, str]:
    """All columns and rows, with columns of a free prefix; and the prefix. Added are the base
    counts, base_failed, class_distance and word_distance (null below the minimum length or
    without references), and kept.

    Null and empty texts have no words and so fail the base rules. Repeated rows are judged alike.
    """
    df, p = measured(docs, text)
    classes, words = histograms(p)
    c, kept = lambda name: F.col(f"{p}{name}"), [F.col(f"`{x}`") for x in docs.columns]
    counts = [c(x) for x in COUNTS]
    df = df.select(*kept, *counts, base_failed(p).alias(p + "base_failed"), F.when(c("n_chars") >= guards.min_chars, classes).alias(p + "c"), F.when(c("n_words") >= guards.min_words, words).alias(p + "w"))
    df = df.select(*kept, *counts, c("base_failed"), nearest(c("c"), [r[0] for r in refs]).alias(p + "class_distance"), nearest(c("w"), [r[1] for r in refs]).alias(p + "word_distance"), F.monotonically_increasing_id().alias(p + "row"))
    near = lambda name, most: F.coalesce(c(name) <= most, F.lit(True))
    verdict = ~c("base_failed") & near("class_distance", guards.class_distance) & near("word_distance", guards.word_distance)
    # The row number is always >= 0; it keeps a later filter on `kept` above the steps.
    return df.withColumn(p + "kept", verdict & (c("row") >= 0)).drop(p + "row"), p


def sql(guards: Guards = Guards()) -> str:
    """The verdict of every document in another engine's SQL."""
    words = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
    rest = ["array_to_string(words, '')"]
    for pattern in CLASSES:
        rest.append(f"regexp_replace({rest[-1]}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g')")
    classes = ", ".join(f"len({a}) - len({b})" for a, b in zip(rest, rest[1:], strict=False)) + f", len(t) - len({rest[0]}), len({rest[-1]})"
    part = "CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    bits = lambda a, b: f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {part.format(a=f'{a}[i]', b=f'{b}[i]')} + {part.format(a=f'{b}[i]', b=f'{a}[i]')}))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{SPACE}'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS v FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, v) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, range({WINDOW}) AS r(k) GROUP BY rid),
base AS (SELECT w.rid, doc_id, lang, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars,
  len(t) - len(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, len(t) AS n_chars, [{classes}] AS classes,
  list_transform({words}, lambda c: len(list_filter(words, lambda x: x = c))) AS common FROM w LEFT JOIN rep USING (rid)),
flagged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  CASE WHEN n_chars >= {guards.min_chars} THEN list_transform(classes, lambda x: x / n_chars) END AS c,
  CASE WHEN n_words >= {guards.min_words} THEN list_transform(list_append(common, n_words - list_sum(common)), lambda x: x / n_words) END AS h FROM base),
good AS (SELECT lang, c, h FROM flagged WHERE lang IS NOT NULL AND {FEW_SYMBOLS} * n_symbols <= n_chars AND c IS NOT NULL AND h IS NOT NULL),
ref_c AS (SELECT lang, list(v ORDER BY i) AS rc FROM (SELECT lang, i, avg(c[i]) AS v FROM good, range(1, {len(CLASSES) + 3}) AS r(i) GROUP BY lang, i) GROUP BY lang),
ref_h AS (SELECT lang, list(v ORDER BY i) AS rh FROM (SELECT lang, i, avg(h[i]) AS v FROM good, range(1, {len(WORDS) + 2}) AS r(i) GROUP BY lang, i) GROUP BY lang),
far AS (SELECT rid, min(sqrt(greatest({bits('c', 'rc')} / 2, 0))) AS fc, min(sqrt(greatest({bits('h', 'rh')} / 2, 0))) AS fh
  FROM flagged, ref_c JOIN ref_h USING (lang) GROUP BY rid)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(fc <= {guards.class_distance}, true) AND coalesce(fh <= {guards.word_distance}, true) AS kept
FROM flagged LEFT JOIN far USING (rid)""".strip()


def verdicts(docs: DataFrame) -> DataFrame:
    """Per document: the base counts and both verdicts."""
    df, p = judged(docs.select("doc_id", "text"), references(docs))
    return df.select("doc_id", *[F.col(p + x).alias(x) for x in (*COUNTS, "base_failed", "kept")])
