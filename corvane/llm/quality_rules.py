"""Quality rules by distribution divergence, with DataFrame functions only.

Two histograms of a document are held against those of each language: that of its characters by class, and
that of its words over the language's most common ones, all others together being one more class. The measure
is the Jensen-Shannon distance (the root of the divergence in bits, 0 to 1). The references are the means over
all documents of a language. A document is kept if, for some language, both distances are small enough; each
rule has a least length, as the histograms of short texts say little.

A null text has no words and is rejected for that, and so is an empty one. Documents without a language, or whose
language has too few documents, add to no reference. Of a document whose language has none, only the base rules decide;
one without a language is held against all references, if there are any. Words that are equally common in a language
are taken in their order. Repeated rows count as often as they are there; an empty table gives an empty one. Texts of
any length count whole. Other columns are passed on; those named like a result are replaced.

References are part of the plan: over LANGUAGES languages with enough documents, judge() raises ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Character classes: name and the characters, as a class of Java's regular expressions. All others but white space are one more.
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{N}", "symbol": r"#*$%&|<>", "stop": r".,;:!?"}
CLASS_NAMES = (*CLASSES, "other")
#: A language's common words, and languages that have references, at most.
COMMON_WORDS, LANGUAGES = 40, 200
#: The largest distance of a text that is kept, by histogram, and the least length from which it counts.
MOST_CLASSES, LEAST_CHARS = 0.27, 100
MOST_WORDS, LEAST_WORDS = 0.45, 40
#: A language needs as many documents for a reference.
LEAST_DOCS = 10
#: What a document counts for in a reference, dealt out to its words: whole numbers, so that sums don't depend on the order.
WEIGHT = 1_000_000_000
#: The columns of the verdict.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")

_SPACE = r"[\x09-\x0D ]"


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with one more column, computed once for each row: filters on what follows are not pushed below a generator, where the optimizer would write the expression out again in each place."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def words_of(text: Column) -> Column:
    """Runs of all but white space; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{_SPACE}+", -1), "")


def _repeated(windows: str) -> str:
    """SQL for the number of words in windows (given as hashes in order) whose hash is there more than once."""
    return f"""
    CASE WHEN size(array_distinct({windows})) = size({windows}) THEN 0L ELSE
      aggregate(
        sort_array(flatten(transform(
          array(sort_array(transform({windows}, (h, i) -> struct(h AS h, i AS i)))),
          s -> filter(transform(s, (x, k) -> CASE WHEN get(s, k - 1).h = x.h OR get(s, k + 1).h = x.h THEN x.i END), i -> i IS NOT NULL)))),
        struct(0L AS n, -9 AS before),
        (a, i) -> struct(a.n + least(5, i - a.before) AS n, i AS before),
        a -> a.n)
    END"""


def _classes(text: Column) -> tuple[list[Column], dict[str, Column]]:
    """How many characters are of each class, and the helping columns to make before, in order."""
    left, counts, steps = text, [], {}
    for name, chars in (("lower", CLASSES["lower"]), ("space", _SPACE[1:-1]), *list(CLASSES.items())[1:]):
        steps[f"_{name}"] = F.regexp_replace(left, f"[{chars}]+", "")
        if name != "space":
            counts.append(F.length(left) - F.length(f"_{name}"))
        left = F.col(f"_{name}")
    return [c.cast("long") for c in (*counts, F.length(left))], steps


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with word_list, the counts of the base rules, base_failed, and class_n (characters by class)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = once(docs, "word_list", words_of(F.col(text)))
    window = ", ".join(f"get(word_list, i + {k})" for k in range(1, 5))
    out = once(out, "_windows", F.expr(f"slice(transform(word_list, (w, i) -> xxhash64(w, {window})), 1, greatest(size(word_list) - 4, 0))"))
    counts, steps = _classes(whole)
    for name, step in steps.items():
        out = out.withColumn(name, step)
    out = out.withColumn("_lines", F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(f"[^{_SPACE[1:-1]}]")))
    values = {
        "n_words": F.size("word_list").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.expr(_repeated("_windows")).cast("long"),
        "class_n": F.array(*counts),
    }
    out = once(out, "base", F.struct(*[c.alias(n) for n, c in values.items()]))
    more = {
        "word_chars": F.aggregate("class_n", F.lit(0).cast("long"), lambda a, x: a + x),
        "n_symbols": F.col("class_n")[CLASS_NAMES.index("symbol")],
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    }
    out = out.withColumns({name: F.col("base")[name] for name in values}).withColumns(more)
    return out.drop("base", "_windows", "_lines", *steps)


def references(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = LANGUAGES) -> list[dict]:
    """By language: class shares, common words and their shares.

    Every document deals WEIGHT out to its characters, and to its words, evenly. The weights are summed by
    language and by language and word, with map-side combining. To the driver come a row for each language and
    the most common words of each: COMMON_WORDS times the languages.
    """
    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts, steps = _classes(F.coalesce(F.col("text"), F.lit("")))
    classed = known
    for name, step in steps.items():
        classed = classed.withColumn(name, step)
    classed = once(classed, "n", F.array(*counts)).withColumn("total", F.greatest(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1)))
    sums = [F.sum(F.call_function("div", WEIGHT * F.col("n")[i], F.col("total"))) for i in range(len(CLASS_NAMES))]
    totals = classed.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.array(*sums).alias("classes"))
    rows = totals.where(F.col("docs") >= LEAST_DOCS).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} languages with {LEAST_DOCS} documents or more")
    found = {r["lang"]: r.asDict() for r in rows}
    listed = once(known.where(F.col("lang").isin(list(found))), "words", words_of(F.col("text")))
    listed = listed.select("lang", F.call_function("div", F.lit(WEIGHT), F.greatest(F.size("words"), F.lit(1))).alias("weight"), F.explode("words").alias("word"))
    by_word = listed.groupBy("lang", "word").agg(F.sum("weight").alias("n"))
    ranked = by_word.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
    for row in ranked.where(F.col("rank") <= COMMON_WORDS).collect():  # each task passes on so many of a language at most
        found[row["lang"]].setdefault("common", {})[row["word"]] = row["n"] / (WEIGHT * found[row["lang"]]["docs"])
    for ref in found.values():
        ref["classes"] = [x / max(1, sum(ref["classes"])) for x in ref["classes"]]
    return [found[name] for name in sorted(found) if "common" in found[name]]


def _term(p: Column, q: Column) -> Column:
    """What one class adds to twice the divergence of p and q."""
    half = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return half(p) + half(q)


def distances(measured: DataFrame, refs: list[dict]) -> DataFrame:
    """measured with the struct distance: c and w, to the language whose larger one of the two, by its limit, is least."""
    words = sorted({w for r in refs for w in r["common"]})
    # a word's number is its place in one string of all: a short search, with which arrays by place are read directly
    line, places = " ", {}
    for w in words:
        places[w] = len(line)
        line += f"{w} "
    listed = F.filter("word_list", lambda w: w.isin(words))  # from ten words on, a look-up in a hash table
    df = once(measured, "_common", F.sort_array(F.transform(listed, lambda w: F.instr(F.lit(line), F.concat(F.lit(" "), w, F.lit(" "))))))
    ends = "filter(sequence(1, greatest(size(_common), 1)), i -> i <= size(_common) AND NOT (get(_common, i - 1) <=> get(_common, i)))"
    df = once(df, "_ends", F.expr(ends))  # equal numbers are neighbours
    seen = "transform(_ends, (e, k) -> struct(get(_common, e - 1) AS place, CAST(e - CASE WHEN k = 0 THEN 0 ELSE get(_ends, k - 1) END AS double) / greatest(n_words, 1) AS p))"
    df = once(df, "_seen", F.expr(seen))
    df = once(df, "_share", F.transform("class_n", lambda x: x / F.greatest(F.col("word_chars"), F.lit(1))))

    def to(ref: dict) -> Column:
        of_classes = sum((_term(F.col("_share")[i], F.lit(q)) for i, q in enumerate(ref["classes"])), F.lit(0.0))
        shares = [0.0] * (len(line) + 1)
        for w, q in ref["common"].items():
            shares[places[w]] = q
        by_place, listed_share = F.lit(shares), sum(ref["common"].values())

        def add(a: Column, x: Column) -> Column:
            q = F.get(by_place, x["place"])
            # a word that only other languages share belongs to the class of all other words here
            return F.when(q > 0, F.struct((a["t"] + _term(x["p"], q) - q).alias("t"), (a["p"] + x["p"]).alias("p"))).otherwise(a)

        # words of the reference that aren't seen add their share each, so all start as unseen
        state = F.aggregate("_seen", F.struct(F.lit(listed_share).alias("t"), F.lit(0.0).alias("p")), add)
        rest = F.transform(F.array(state), lambda a: a["t"] + _term(F.greatest(1 - a["p"], F.lit(0.0)), F.lit(max(0.0, 1 - listed_share))))[0]
        root = lambda x: F.sqrt(F.greatest(x / 2, F.lit(0.0)))
        return F.struct(root(of_classes).alias("c"), root(rest).alias("w"))

    worst = lambda x: F.struct(F.greatest(x["c"] / MOST_CLASSES, x["w"] / MOST_WORDS).alias("worst"), x["c"].alias("c"), x["w"].alias("w"))
    df = once(df, "distance", F.array_min(F.transform(F.array(*[to(r) for r in refs]), worst)))
    return df.drop("_common", "_ends", "_seen", "_share")


def judge(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with the counts of the base rules, base_failed, kept, class_distance and word_distance (to six places).

    Two passes over docs: one sums up the references, one judges. A row's verdict needs no shuffle.
    """
    names = docs.columns
    docs = docs.toDF(*[f"_{k}" for k in range(len(names))])  # no name of the caller's stands in the way of ours
    text, lang = f"_{names.index(text)}", f"_{names.index(lang)}"
    refs = references(docs, text, lang)
    measured = measure(docs, text)
    measured = distances(measured, refs) if refs else measured.withColumn("distance", F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("w")))
    fits = (F.col("word_chars") < LEAST_CHARS) | (F.col("distance.c") <= MOST_CLASSES)
    fits &= (F.col("n_words") < LEAST_WORDS) | (F.col("distance.w") <= MOST_WORDS)
    if refs:
        fits |= F.col(lang).isNotNull() & ~F.col(lang).isin([r["lang"] for r in refs])
    out = measured.withColumns({"class_distance": F.round("distance.c", 6), "word_distance": F.round("distance.w", 6), "kept": ~F.col("base_failed") & fits})
    return out.select(*[F.col(f"_{k}").alias(n) for k, n in enumerate(names) if n not in RESULTS], *RESULTS)


def keep(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs that judge() keeps, as they are."""
    names = docs.columns
    numbered = docs.toDF(*[f"c{k}" for k in range(len(names))])
    judged = judge(numbered, f"c{names.index(text)}", f"c{names.index(lang)}")
    return judged.where("kept").select(numbered.columns).toDF(*names)


def verdicts(spark, sf_dir: str) -> DataFrame:
    """The query: every document's counts, distances and verdict."""
    return judge(common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("text", "lang")


def oracle() -> str:
    """The query in SQL: the same references, as tables, and the same distances."""
    space = "[\\x09-\\x0D ]"
    strip, left = [], "t"
    for name in ("lower", "space", *list(CLASSES)[1:]):
        chars = CLASSES[name] if name != "space" else "\\x09-\\x0D "
        strip.append((name, left, f"regexp_replace({left}, '[{chars}]+', '', 'g')"))
        left = f"s_{name}"
    steps = ", ".join(f"a{k} AS (SELECT *, {made} AS s_{name} FROM {f'a{k - 1}' if k else 'doc'})" for k, (name, _, made) in enumerate(strip))
    counts = ", ".join(f"length({before}) - length(s_{name})" for name, before, _ in strip if name != "space")
    half = lambda x, p, q: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({p} + {q})) ELSE 0 END"
    term = lambda p, q: f"({half(p, p, q)} + {half(q, p, q)})"
    return f"""WITH doc AS (SELECT doc_id, lang, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents), {steps},
cls AS (SELECT r, doc_id, lang, t, [{counts}, length({left})] AS n FROM a{len(strip) - 1}),
wrd AS (SELECT *, list_sum(n)::BIGINT AS chars, list_filter(string_split_regex(t, '{space}+'), lambda w: w <> '') AS w FROM cls),
ref AS (SELECT lang, count(*) AS docs, [{", ".join(f"sum(({WEIGHT}::BIGINT * n[{i + 1}]) // greatest(chars, 1))" for i in range(len(CLASS_NAMES)))}] AS c FROM wrd WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {LEAST_DOCS}),
com AS (SELECT lang, word, sum(weight) AS n FROM (SELECT lang, {WEIGHT}::BIGINT // greatest(len(w), 1) AS weight, unnest(w) AS word FROM wrd WHERE lang IN (SELECT lang FROM ref)) GROUP BY lang, word QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {COMMON_WORDS}),
shr AS (SELECT lang, word, com.n::DOUBLE / ({WEIGHT}::DOUBLE * docs) AS q FROM com JOIN ref USING (lang)),
rest AS (SELECT lang, sum(q) AS listed FROM shr GROUP BY lang),
pos AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS k FROM wrd),
tf AS (SELECT r, word, count(*)::DOUBLE / any_value(k) AS p FROM pos GROUP BY r, word),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c, d, e) AS c FROM (SELECT r, i, k, word AS a, lead(word, 1) OVER x AS b, lead(word, 2) OVER x AS c, lead(word, 3) OVER x AS d, lead(word, 4) OVER x AS e FROM pos WINDOW x AS (PARTITION BY r ORDER BY i)) WHERE i <= k - 4),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM win, range(5) t(o) WHERE c > 1 GROUP BY r),
lin AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM wrd) WHERE regexp_matches(line, '[^\\x09-\\x0D ]') GROUP BY r),
met AS (SELECT tf.r, shr.lang AS l, sum({term("p", "q")} - q) AS t, sum(p) AS p FROM tf JOIN shr USING (word) GROUP BY tf.r, shr.lang),
dist AS (SELECT wrd.r, x.lang AS l, sqrt(greatest(({" + ".join(term(f"(wrd.n[{i + 1}] / greatest(chars, 1)::DOUBLE)", f"(x.c[{i + 1}] / x.tot)") for i in range(len(CLASS_NAMES)))}) / 2, 0)) AS c,
 sqrt(greatest((listed + coalesce(met.t, 0) + {term("greatest(1 - coalesce(met.p, 0), 0)", "greatest(1 - listed, 0)")}) / 2, 0)) AS w
 FROM wrd CROSS JOIN (SELECT lang, c, greatest(list_sum(c), 1)::DOUBLE AS tot FROM ref) x JOIN rest ON rest.lang = x.lang LEFT JOIN met ON met.r = wrd.r AND met.l = x.lang),
best AS (SELECT r, c, w FROM dist QUALIFY row_number() OVER (PARTITION BY r ORDER BY greatest(c / {MOST_CLASSES}, w / {MOST_WORDS}), c, w) = 1),
base AS (SELECT wrd.r, doc_id, lang, len(w)::BIGINT AS n_words, chars AS word_chars, wrd.n[{CLASS_NAMES.index("symbol") + 1}]::BIGINT AS n_symbols, coalesce(lin.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM wrd LEFT JOIN lin ON lin.r = wrd.r LEFT JOIN rep ON rep.r = wrd.r),
judged AS (SELECT base.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(c, 0) AS c, coalesce(best.w, 0) AS w FROM base LEFT JOIN best ON best.r = base.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ((word_chars < {LEAST_CHARS} OR c <= {MOST_CLASSES}) AND (n_words < {LEAST_WORDS} OR w <= {MOST_WORDS}) OR (EXISTS (SELECT 1 FROM ref) AND lang IS NOT NULL AND lang NOT IN (SELECT lang FROM ref))) AS kept, round(c, 6) AS class_distance, round(w, 6) AS word_distance FROM judged"""
