"""Ranked search: lexical, by vector, and both together."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T


#: Postings, inverted: a row for each term and document. Totals: a row for the documents counted.
POSTINGS = "term string, id string, places array<int>, length int"
TOTALS = "docs long, terms long"


def tokens(docs: DataFrame, id: str = "id", text: str = "code") -> DataFrame:
    """(id, terms, length)."""
    found = T.once(docs.select(F.col(id).alias("id"), F.col(text).alias("_text")), "terms", T.terms(F.col("_text"))).drop("_text")
    return found.withColumn("length", F.size("terms"))


def postings(docs: DataFrame, id: str = "id", text: str = "code", *more: str) -> DataFrame:
    """(term, id, places, length, and more columns of docs): to be written once, by term, and read by all searches.

    A document's terms are gathered in its own row, so nothing is shuffled here.
    """
    own = T.once(docs.select(F.col(id).alias("id"), *more, F.col(text).alias("_text")), "_terms", T.terms(F.col("_text")))
    own = own.withColumn("length", F.size("_terms"))
    numbered = F.transform("_terms", lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    own = T.once(own, "_sorted", F.sort_array(numbered))
    # equal terms are neighbours: where one ends, the next one's places begin
    ends = F.filter(F.transform("_sorted", lambda x, k: F.struct(k.alias("k"), x["t"].alias("t"), (F.get(F.col("_sorted"), k + 1)["t"].eqNullSafe(x["t"])).alias("more"))), lambda e: ~e["more"])
    own = T.once(own, "_ends", ends)
    first = lambda n: F.coalesce(F.get(F.col("_ends"), n - 1)["k"] + 1, F.lit(0))
    parts = F.transform("_ends", lambda e, n: F.struct(e["t"].alias("term"), F.transform(F.slice(F.col("_sorted"), first(n) + 1, e["k"] + 1 - first(n)), lambda x: x["i"]).alias("places")))
    return own.select("id", *more, "length", F.inline(parts)).select("term", "id", "places", "length", *more)


def totals(docs: DataFrame, text: str = "code") -> DataFrame:
    """(docs, terms): how many documents there are, and terms in them."""
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.size(T.terms(F.col(text)))), F.lit(0)).cast("long").alias("terms"))


#: Places after the point that the order of a list goes by: sums of the same parts differ beyond, by the order in which tasks add them up.
DIGITS = 9


def rounded(score: Column, digits: int) -> Column:
    """score to so many places as SQL engines round a double: the nearest whole multiple. (Spark rounds what is printed, so halves can differ.)"""
    return F.round(score * 10.0**digits) / 10.0**digits


def _best(scored: DataFrame, k: int | None) -> DataFrame:
    """The best k of (id, score), scores to DIGITS places; of equal ones those of the smallest ids."""
    return scored.withColumn("score", rounded(F.col("score"), DIGITS)).orderBy(F.desc("score"), "id").limit(k) if k else scored


def _occurrences(phrase: tuple[str, ...]) -> Column:
    """How often a phrase's terms stand side by side, from the places of each (a map from term to places)."""
    def starts(k: int) -> Column:
        """Where the phrase would begin for its k-th term to be where it is."""
        return F.transform(F.coalesce(F.try_element_at("_places", F.lit(phrase[k])), F.array().cast("array<int>")), lambda p: p - k)

    found = starts(0)
    for k in range(1, len(phrase)):
        found = F.array_intersect(found, starts(k))
    return F.size(found)


def bm25(index: DataFrame, whole: DataFrame, phrases: list[list[str]], k: int | None = C.TOP_K, scope: Column | None = None) -> DataFrame:
    """(id, score) of the best k documents that have a phrase (all for None, with whole scores). index: postings; whole: totals, of one row or more.

    Only the rows of the query's terms are read. N, document counts and lengths are those of the whole table, whatever the
    scope; a term that is repeated counts as often. A single term's row says how often a document has it; only the rows
    of phrases of several terms meet by document first.
    """
    if not phrases:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    times = {p: float(sum(tuple(q) == p for q in phrases)) for p in dict.fromkeys(map(tuple, phrases))}
    inside = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    single, longer = [p[0] for p in times if len(p) == 1], [p for p in times if len(p) > 1]
    found = index.where(F.col("term").isin(single)).select("id", F.col("term").alias("phrase"), F.size("places").alias("f"), "length", inside.alias("_in"))
    if longer:
        rows = index.where(F.col("term").isin(sorted({t for p in longer for t in p})))
        each = rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("_places"), F.first("length").alias("length"), F.max(inside).alias("_in"))
        counts = F.array(*[F.struct(F.lit(" ".join(p)).alias("phrase"), _occurrences(p).alias("f")) for p in longer])
        each = each.select("id", "length", "_in", F.inline(counts)).where("f > 0").select("id", "phrase", "f", "length", "_in")
        found = each if not single else found.union(each)
    sums = whole.agg(F.sum("docs").alias("n"), F.sum("terms").alias("terms"))  # one row
    counted = found.groupBy("phrase").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(sums))  # a row for each phrase
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    often = F.create_map(*[F.lit(x) for p, t in times.items() for x in (" ".join(p), t)])
    weights = counted.select("phrase", (F.when(idf <= 0, F.lit(C.LEAST_IDF)).otherwise(idf) * often[F.col("phrase")]).alias("weight"), (F.col("terms") / F.col("n")).alias("mean"))
    norm = C.K1 * (1 - C.B + C.B * F.col("length") / F.col("mean"))
    parts = found.where("_in").join(F.broadcast(weights), "phrase").select("id", (F.col("weight") * (F.col("f") * (C.K1 + 1)) / (F.col("f") + norm)).alias("part"))
    scored = parts.groupBy("id").agg(F.sum("part").alias("score"))
    return _best(scored, k)


def cosine(vectors: DataFrame, query: list[float], k: int | None = C.TOP_K, id: str = "id", vector: str = "vector") -> DataFrame:
    """(id, score) of the k vectors nearest to the query (all for None, with whole scores); null and empty vectors are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    length = sum(float(x) ** 2 for x in query) ** 0.5
    known = vectors.where(F.size(F.coalesce(F.col(vector), F.array().cast("array<float>"))) > 0)
    scored = known.select(F.col(id).alias("id"), (dot / ((norm + 1e-9) * (length + 1e-9))).alias("score"))
    return _best(scored, k)


def filters(lang: str | None = None, path_glob: str | None = None, since: datetime | None = None, author: str | None = None) -> Column:
    """What a hit's metadata must fulfil."""
    out = F.lit(True)
    if lang:
        out = out & (F.col("language") == lang)
    if path_glob:
        out = out & T.glob(F.col("path"), path_glob)
    if since:
        out = out & F.coalesce(F.col("last_modified") >= F.lit(since), F.lit(False))
    if author:
        out = out & (F.instr(F.lower(F.coalesce("last_author", F.lit(""))), author.lower()) > 0)
    return F.coalesce(out, F.lit(False))


def ranked(hits: DataFrame) -> DataFrame:
    """hits (id, score) with rank from 1 on; lists are as long as a search returns, so one task sorts them."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def fuse(vector: DataFrame, lexical: DataFrame, k: int = C.RRF_K, limit: int = C.FUSED) -> DataFrame:
    """(id, rrf, position, vector_rank, lexical_rank): reciprocal ranks of two ranked lists added up, the best `limit`."""
    a = vector.select("id", F.col("rank").alias("vector_rank"))
    b = lexical.select("id", F.col("rank").alias("lexical_rank"))
    both = a.join(b, "id", "full_outer")
    both = both.withColumn("rrf", F.coalesce(1.0 / (k + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("lexical_rank")), F.lit(0.0)))
    order = (F.desc("rrf"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("lexical_rank"))
    return both.withColumn("position", F.row_number().over(Window.orderBy(*order))).where(F.col("position") <= limit)


def overlap_reranker(query: str, text: Column) -> Column:
    """A model-free reranker: the share of the query's terms that the text has."""
    own = sorted({t for p in T.phrases(query) for t in p})
    if not own:
        return F.lit(0.0)
    return F.size(F.array_intersect(T.terms(text), F.array(*[F.lit(t) for t in own]))) / F.lit(float(len(own)))


def diversify(reranked: DataFrame, k: int, per_file: int = C.MAX_PER_FILE) -> DataFrame:
    """Candidates (id, path, score, position, rrf) with rank (by score), nth (of their path), dropped, place and guarded: those with a place are picked.

    The first k by score are, `per_file` of a path at most; the fused list's first is always among them, in the last
    place and with its fused score if need be. All in one row, as there are FUSED candidates at most.
    """
    row = F.struct((-rounded(F.col("score"), 3)).alias("order"), F.col("position"), F.col("id"), F.col("path"), F.col("score"), F.col("rrf"))
    listed = reranked.agg(F.sort_array(F.collect_list(row)).alias("_all"))
    nth = F.transform("_all", lambda x, i: F.struct(x["id"].alias("id"), x["path"].alias("path"), x["score"].alias("score"), x["rrf"].alias("rrf"), x["position"].alias("position"), (i + 1).alias("rank"), F.size(F.filter(F.slice(F.col("_all"), F.lit(1), i + 1), lambda y: y["path"].eqNullSafe(x["path"]))).alias("nth")))
    listed = T.once(listed, "_nth", nth)
    listed = T.once(listed, "_picked", F.slice(F.filter("_nth", lambda x: x["nth"] <= per_file), F.lit(1), F.lit(k)))
    listed = listed.withColumn("_has", F.exists("_picked", lambda x: x["position"] == 1) | ~F.exists("_nth", lambda x: x["position"] == 1) | (F.size("_picked") == 0))
    listed = listed.withColumn("_stay", F.when(F.col("_has"), F.size("_picked")).otherwise(F.least(F.size("_picked"), F.lit(k - 1))))
    listed = listed.withColumn("_until", F.when(F.size("_picked") >= k, F.get("_picked", F.lit(k - 1))["rank"]))
    rows = listed.select("_picked", "_has", "_stay", "_until", F.explode("_nth").alias("x"))
    place = F.array_position(F.transform(F.slice("_picked", F.lit(1), F.col("_stay")), lambda y: y["position"]), F.col("x.position"))
    guarded = ~F.col("_has") & (F.col("x.position") == 1)
    dropped = (F.col("x.nth") > per_file) & F.coalesce(F.col("x.rank") < F.col("_until"), F.lit(True))
    rows = rows.select("x.*", dropped.alias("dropped"), guarded.alias("guarded"), F.when(guarded, F.col("_stay") + 1).when(place > 0, place).cast("int").alias("place"))
    return rows.withColumn("score", F.when(F.col("guarded"), F.col("rrf")).otherwise(F.col("score")))


def hybrid(chunks: DataFrame, index: DataFrame, whole: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], k: int = C.FINAL, where: Column | None = None, repo: str | None = None, rerank=None, prefilter: bool = False) -> dict[str, DataFrame]:
    """All stages of a search by name: vector, lexical, fused, candidates, rerank, dropped, guard, final.

    chunks: id, repo, path, language, code and more; index: postings() with repo; whole: totals(); vectors: id, vector, repo.
    Of index and vectors only the repository's rows can be picked, by their own column. Filters hold after the best of
    each list are taken, unless prefilter. rerank: (query, text column) to a score; without it, or with one candidate
    only, the fused order is final. The lists are 20 rows each, and are broadcast to the tables they meet.
    """
    scope = None if repo in (None, "all") else F.col("repo") == repo
    allowed = None if where is None else chunks.where(where).select("id")
    own_vectors = vectors if scope is None else vectors.where(scope)
    own_index = index
    if prefilter and allowed is not None:
        own_vectors = own_vectors.join(allowed, "id", "left_semi")
        own_index = index.where(F.col("term").isin(sorted({t for p in T.phrases(query) for t in p}))).join(allowed.withColumn("_allowed", F.lit(True)), "id", "left")
        scope = F.coalesce("_allowed", F.lit(False)) & (F.lit(True) if scope is None else scope)
    by_vector = cosine(own_vectors, query_vector)
    by_terms = bm25(own_index, whole, T.phrases(query), scope=scope)
    if allowed is not None and not prefilter:
        by_vector, by_terms = (chunks.where(where).join(F.broadcast(x), "id").select("id", "score") for x in (by_vector, by_terms))
    by_vector, by_terms = ranked(by_vector), ranked(by_terms)
    fused = fuse(by_vector, by_terms)
    candidates = chunks.join(F.broadcast(fused), "id")
    out = {"vector": by_vector, "lexical": by_terms, "fused": fused, "candidates": candidates}
    plain = candidates.where(F.col("position") <= k).select("id", "path", F.col("rrf").alias("score"), F.col("position").alias("place"), F.lit(False).alias("guarded"))
    if rerank is None:
        return out | {"final": plain}
    scored = candidates.withColumn("score", rerank(query, F.col("code")))
    picked = diversify(scored, k)
    out["rerank"] = picked.join(scored.select("id", F.col("score").alias("reranked")), "id").select("id", "path", F.col("reranked").alias("score"), "rank")
    out["dropped"] = picked.where("dropped").select("id", "path", "rank", F.lit("max_per_file").alias("reason"))
    out["guard"] = picked.where("guarded").select("id", "path", "place")
    several = F.col("n") > 1
    final = picked.where("place is not null").select("id", "path", "score", "place", "guarded")
    n = candidates.agg(F.count(F.lit(1)).alias("n"))
    out["final"] = final.crossJoin(F.broadcast(n)).where(several).drop("n").unionByName(plain.crossJoin(F.broadcast(n)).where(~several).drop("n"))
    return out


def present(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits as a caller gets them: with code, lines, role and the range to read around them."""
    role = T.file_role(F.col("path"), F.col("language"))
    found = chunks.drop("score").join(F.broadcast(hits.select("id", "score", "place")), "id").withColumn("file_role", role)
    return found.withColumns(
        {
            "suggested_ranges": F.array(T.context_range(F.col("lineno_start"), F.col("lineno_end"))),
            "is_test": F.col("file_role") == "test",
            "is_doc": F.col("file_role") == "docs",
            "is_config": F.col("file_role") == "config",
            "context_trust": F.lit(C.TRUST),
        }
    )
