"""Quality rules by distribution divergence, in DataFrame functions alone.

A document's histograms of character classes and of common words are compared
with references of its language by Jensen-Shannon distance (the square root of
the divergence in bits, so between 0 and 1). The references are the summed
histograms of all documents of that language that pass the base rules; a
document without a language is held against those of all documents.

Base rules (fixed): words are `[^\\x20\\x09-\\x0D]+`; a document fails with fewer
than 50 words, or if over half of its words lie in 3-word windows that the text
has twice or more.

Common words are learned: of the words with a letter that at least MIN_SHARE of a
language's documents have, the N_COMMON that most have (by all documents; equal
ones in order). A word histogram has a bin for each and one for all other words.
Languages of under MIN_REFERENCE_DOCS documents, and documents
without one, are held against the characters and common words of all documents (words
summed over those that have no reference of their own).

Verdict: base passed, character distance at most CHAR_FACTOR times the references' documents'
median, and squared word distance at most WORD_FACTOR squared times spread + N_COMMON / (8 ln 2 n).
The second term is what sampling n words from the reference itself gives; the
spread is the median, over the documents that make the references, of what is beyond it. So
the limit is as strict for long texts as for short ones. Minimum-length guard: the word
histogram of a text of under MIN_WORDS_FOR_COMMON words is too thin to judge and isn't held against it.

Defined results: a null or empty text has no words and fails the base; repeated
rows each give a row; other columns are ignored.

Cost: two passes over the texts, one to learn the common words (texts' distinct words are
counted on the map side), one to measure. Each text's row of counts (about 40 numbers)
is written and joined with a reference of one row a language; texts are
never shuffled. Repeats are found by sorting a text's own window hashes, n log n
in its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

MIN_WORDS = 50
MIN_WORDS_FOR_COMMON = 60
MIN_REFERENCE_DOCS = 20
MIN_SHARE = 0.01
N_COMMON = 20
WORD_FACTOR = 1.45
CHAR_FACTOR = 3.0
#: The limits of a corpus without any reference document.
CHAR_MEDIAN, SPREAD = 0.1, 0.01
#: 8 ln 2: a histogram of n draws from k + 1 bins has a squared distance of about k / (8 ln 2 n) bits from what it was drawn from.
SAMPLING = 5.545177444479562

#: Character classes, taken off a text one after the other; what is left is the last class.
CLASSES = (("lower", "[a-z]+"), ("space", "[ \\t\\n\\x0B\\f\\r]+"), ("symbol", "[#*$%&|<>]+"), ("mark", "[.,;:!?'\"()-]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("letter", "\\p{L}+"))
N_CLASSES = len(CLASSES) + 1


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = "filter(split({}, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"


def common_words(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(lang, common) of the languages with references of their own, and the common words of all documents."""
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    d = docs.select(F.col("lang").cast("string").alias("lang"), low.alias("t"))
    words = d.select("lang", F.explode(F.expr(f"array_distinct({_WORDS.format('t')})")).alias("word")).where(F.col("word").rlike("[^\\x00-\\x60\\x7B-\\x7F]"))
    counted = cut(words.groupBy("lang", "word").count().where("count > 1"))
    sizes = cut(d.groupBy("lang").agg(F.count("*").alias("docs")))  # a row a language
    own = counted.join(sizes.where(F.col("lang").isNotNull() & (F.col("docs") >= MIN_REFERENCE_DOCS)), "lang").where(F.col("count") >= MIN_SHARE * F.col("docs"))
    # few words of a language reach the share: at most 1 / MIN_SHARE times the words of a text
    ranked = own.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("count"), "word"))).where(F.col("rank") <= N_COMMON)
    lists = cut(ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("r")).select("lang", F.col("r.word").alias("common"), F.expr("array_max(transform(r, x -> octet_length(x.word)))").alias("longest")))
    total = sizes.agg(F.sum("docs")).first()[0] or 0
    every = counted.groupBy("word").agg(F.sum("count").alias("count")).where(F.col("count") >= MIN_SHARE * total).orderBy(F.desc("count"), "word").limit(N_COMMON)
    return lists, [r.word for r in every.collect()]


def measured(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, ref (the language whose reference counts, null: that of all), the contract's counts, and both histograms as arrays of longs."""
    lists, every = common_words(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("t")).join(lists.withColumn("ref", F.col("lang")), "lang", "left")
    all_words = F.array(*map(F.lit, every)) if every else F.array().cast("array<string>")
    longest = F.coalesce("longest", F.lit(max((len(w.encode()) for w in every), default=0)))
    d = d.select("doc_id", "ref", "t", F.coalesce("common", all_words).alias("common"), longest.alias("longest"), F.expr(_WORDS.format("t")).alias("w"))
    lines = F.expr("filter(split(t, '\\n', -1), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')")
    short = "filter(w, x -> octet_length(x) <= longest)"  # only words that can be common are compared
    places = F.expr(f"filter(transform({short}, x -> array_position(common, translate(x, '{_UPPER}', '{_LOWER}'))), p -> p > 0)")
    d = d.select("doc_id", "ref", "t", F.size("w").alias("n"), F.expr("transform(w, x -> xxhash64(x))").alias("h"), places.alias("places"), lines.alias("lines"))
    # hashes of the 3-word windows, sorted, so that equal ones are neighbours; a window that runs over the end gets a place of its own
    d = d.select("*", F.expr("sort_array(transform(slice(h, 1, greatest(n - 2, 0)), (x, i) -> struct(xxhash64(x, h[i + 1], h[i + 2]) AS g, i AS i)))").alias("g"))
    twice = "filter(g, (x, j) -> x.g = get(g, j - 1).g OR x.g = get(g, j + 1).g)"
    d = d.select("doc_id", "ref", "t", "n", "places", "lines", F.expr(f"sort_array(transform({twice}, x -> x.i))").alias("p"))
    covered = F.expr("aggregate(transform(p, (x, j) -> least(3, coalesce(get(p, j + 1) - x, 3))), 0, (a, x) -> a + x)").cast("long")
    words = F.expr(f"transform(sequence(1, {N_COMMON}), i -> CAST(size(places) - size(array_remove(places, CAST(i AS BIGINT))) AS BIGINT))")
    d = d.select("doc_id", "ref", "t", F.col("n").cast("long").alias("n_words"), covered.alias("n_repeat_words"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.concat(words, F.array((F.col("n") - F.size("places")).cast("long"))).alias("words"))
    left = "t"
    for name, pattern in CLASSES:
        d = d.withColumn(f"t_{name}", F.regexp_replace(left, pattern, ""))
        d = d.withColumn(name, (F.char_length(left) - F.char_length(f"t_{name}")).cast("long")).drop(left)
        left = f"t_{name}"
    d = d.withColumn("rest", F.char_length(left).cast("long")).drop(left)
    names = [n for n, _ in CLASSES] + ["rest"]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    word_chars = sum((F.col(n) for n in names if n != "space"), F.lit(0).cast("long"))
    return d.select("doc_id", "ref", "n_words", word_chars.alias("word_chars"), F.col("symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.array(*names).alias("chars"), "words")


def references(rows: DataFrame) -> DataFrame:
    """(ref, ref_chars, ref_words): summed histograms of the documents that pass the base rules, by language; under null the characters of all of them, and the words of those without a reference of their own."""
    good = rows.where(~F.col("base_failed"))
    sums = lambda name, n: F.array(*[F.sum(F.col(name)[i]) for i in range(n)])
    by = good.groupBy("ref").agg(sums("chars", N_CLASSES).alias("ref_chars"), sums("words", N_COMMON + 1).alias("ref_words"))
    by = cut(by)
    every = by.agg(sums("ref_chars", N_CLASSES).alias("s")).first().s
    return by.withColumn("ref_chars", F.when(F.col("ref").isNull(), F.array(*[F.lit(x).cast("long") for x in every])).otherwise(F.col("ref_chars")))


def shares(counts: str) -> Column:
    """Counts as shares of their sum, null without any."""
    total = F.expr(f"aggregate({counts}, 0L, (a, v) -> a + v)")
    return F.when(total > 0, F.transform(F.col(counts), lambda v: v / total))


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two arrays of shares: from the entropies of both and of their mean."""
    term = "CASE WHEN {0} > 0 THEN {0} * log2({0}) ELSE 0D END".format
    each = f"zip_with({p}, {q}, (x, y) -> {term('x')} + {term('y')} - 2 * {term('((x + y) / 2)')})"
    return F.expr(f"CASE WHEN {p} IS NOT NULL AND {q} IS NOT NULL THEN sqrt(greatest(0D, 0.5D * aggregate({each}, 0D, (a, v) -> a + v))) END")


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text, lang): the contract's counts, both distances, base_failed and kept."""
    rows = cut(measured(docs))
    own = references(rows).select(F.col("ref").alias("own"), shares("ref_chars").alias("rc"), shares("ref_words").alias("rw"))  # a row a language
    d = rows.withColumns({"c": shares("chars"), "w": shares("words")}).join(cut(own), F.col("ref").eqNullSafe(F.col("own")), "left")
    d = cut(d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance("c", "rc").alias("cd"), distance("w", "rw").alias("wd")))
    # distances are rounded so that the exact medians hold few values
    judged, beyond = F.col("n_words") >= MIN_WORDS_FOR_COMMON, F.round(F.col("wd") * F.col("wd") - N_COMMON / (SAMPLING * F.col("n_words")), 4)
    m = d.where(~F.col("base_failed")).agg(F.expr("percentile(round(cd, 4), 0.5)").alias("cd"), F.percentile(F.when(judged, beyond), F.lit(0.5)).alias("spread")).first()
    char_limit = CHAR_FACTOR * (m.cd if m.cd is not None else CHAR_MEDIAN)
    spread = max(m.spread if m.spread is not None else SPREAD, 0.0001)
    word_limit = WORD_FACTOR * F.sqrt(F.lit(spread) + N_COMMON / (SAMPLING * F.col("n_words")))
    fits = (F.coalesce("cd", F.lit(0.0)) <= char_limit) & (~judged | (F.coalesce("wd", F.lit(0.0)) <= word_limit))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fits).alias("kept"), F.round("cd", 4).alias("char_distance"), F.round("wd", 4).alias("word_distance"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _sql_distance(p: str, q: str) -> str:
    """DuckDB: the distance of two lists of counts."""
    share = lambda x: f"list_transform({x}, lambda v: v / list_sum({x})::DOUBLE)"
    half = lambda a, b: f"list_sum(list_transform(list_zip({share(a)}, {share(b)}), lambda s: CASE WHEN s[1] > 0 THEN s[1] * log2(s[1] / ((s[1] + s[2]) / 2)) ELSE 0 END))"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, 0.5 * ({half(p, q)} + {half(q, p)}))) END"


def _sql() -> str:
    quoted = lambda pattern: pattern.replace("'", "''")
    names = [n for n, _ in CLASSES]
    steps, left = [], "t"
    for i, (name, pattern) in enumerate(CLASSES):
        steps.append(f"c{i} AS (SELECT * EXCLUDE (t), length(t) - length(regexp_replace(t, '{quoted(pattern)}', '', 'g')) AS {name}, regexp_replace(t, '{quoted(pattern)}', '', 'g') AS t FROM {'d' if i == 0 else f'c{i - 1}'})")
    chars = ", ".join([*names, f"length({left})"])
    return f"""
WITH raw AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
d AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, regexp_extract_all(translate(t, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS lw,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM raw),
df AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(list_distinct(lw)) AS word FROM d) WHERE regexp_matches(word, '[^\\x00-\\x60\\x7B-\\x7F]') GROUP BY 1, 2 HAVING count(*) > 1),
sizes AS (SELECT lang, count(*) AS docs FROM d GROUP BY 1),
lists AS (SELECT lang, list(word ORDER BY n DESC, word) AS common FROM (
            SELECT df.lang, word, n FROM df JOIN sizes ON df.lang = sizes.lang WHERE docs >= {MIN_REFERENCE_DOCS} AND n >= {MIN_SHARE} * docs
            QUALIFY row_number() OVER (PARTITION BY df.lang ORDER BY n DESC, word) <= {N_COMMON}) GROUP BY lang),
every AS (SELECT list(word ORDER BY n DESC, word) AS words FROM (
            SELECT word, sum(n) AS n FROM df GROUP BY word HAVING sum(n) >= {MIN_SHARE} * (SELECT sum(docs) FROM sizes) ORDER BY n DESC, word LIMIT {N_COMMON})),
grams AS (SELECT rid, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
twice AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
{", ".join(steps)},
m AS (SELECT c.rid, doc_id, lists.lang AS ref, len(w)::BIGINT AS n_words, symbol::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, [{chars}]::BIGINT[] AS chars, space,
             lw, coalesce(common, (SELECT words FROM every), []) AS common
      FROM c{len(CLASSES) - 1} c LEFT JOIN rep USING (rid) LEFT JOIN lists ON c.lang = lists.lang),
h AS (SELECT *, list_transform(range(1, {N_COMMON + 1}), lambda i: CASE WHEN i <= len(common) THEN len(list_filter(lw, lambda x: x = common[i])) ELSE 0 END) AS bins FROM m),
r AS (SELECT *, (list_sum(chars) - space)::BIGINT AS word_chars, list_append(bins, n_words - list_sum(bins))::BIGINT[] AS words,
             n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM h),
own AS (SELECT ref, [{", ".join(f"sum(chars[{i + 1}])" for i in range(N_CLASSES))}]::BIGINT[] AS rc, [{", ".join(f"sum(words[{i + 1}])" for i in range(N_COMMON + 1))}]::BIGINT[] AS rw
        FROM r WHERE NOT base_failed GROUP BY ref),
every_chars AS (SELECT [{", ".join(f"sum(chars[{i + 1}])" for i in range(N_CLASSES))}]::BIGINT[] AS ac FROM r WHERE NOT base_failed),
refs AS (SELECT ref, CASE WHEN ref IS NULL THEN ac ELSE rc END AS rc, rw FROM own, every_chars),
x AS (SELECT r.*, {_sql_distance("chars", "rc")} AS cd, {_sql_distance("words", "rw")} AS wd FROM r LEFT JOIN refs ON r.ref IS NOT DISTINCT FROM refs.ref),
med AS (SELECT {CHAR_FACTOR} * coalesce(median(round(cd, 4)), {CHAR_MEDIAN}) AS char_limit,
               greatest(coalesce(median(CASE WHEN n_words >= {MIN_WORDS_FOR_COMMON} THEN round(wd * wd - {N_COMMON} / ({SAMPLING} * n_words), 4) END), {SPREAD}), 0.0001) AS spread FROM x WHERE NOT base_failed)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(cd, 0) <= char_limit AND (n_words < {MIN_WORDS_FOR_COMMON} OR coalesce(wd, 0) <= {WORD_FACTOR} * sqrt(spread + {N_COMMON} / ({SAMPLING} * n_words))) AS kept,
       round(cd, 4) AS char_distance, round(wd, 4) AS word_distance
FROM x, med
"""


SQL = _sql()
