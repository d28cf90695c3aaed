"""The registered queries: each of the engine's operators over the driver's tables.

Documents stand for nodes: collection is their source, the path is lang/doc_id.md.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.api import scoped
from lodeweave.functions.analyzer import parse_query
from lodeweave.functions.html import html_to_markdown
from lodeweave.functions.markdown import TARGET
from lodeweave.functions.text import clip, conservative_tokens, token_estimate, words_of
from lodeweave.functions.uri import encoded, encoded_path, parse_uri, source_path
from lodeweave.operators import blocks, catalog, containment, files, fts, fusion, ingest, sinks, vectors
from lodeweave.operators.numbering import number_rows
from lodeweave.plans import engine_queries, function_queries
from lodeweave.store import WRITTEN
from lodeweave.streaming.watch import NOTICES, changed_since, kept_running, write_notices

# The queries' texts and limits.
Q_WORDS = "the that from"
Q_OTHER = "which have been"
Q_PHRASE = '"of the"'
Q_NEGATED = "the -for"
Q_OR = "that or which"
Q_COVER = "the that -for"
Q_STEMMED = "things oned tion"
TOP, PER_QUERY = 10, 30
EVERY = 20  # query vectors are those whose id it divides


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    shaped = d.select(
        F.col("doc_id").alias("id"), F.lit("doc").alias("kind"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), F.col("source").alias("collection"),
        path.alias("path"), F.lit("doc").alias("role"), F.length("text").cast("long").alias("size_bytes"), F.col("text").alias("content"),
    )
    return shaped.withColumn("uri", F.concat(F.lit("ctx://docs/"), encoded(F.col("collection")), F.lit("/"), encoded_path(F.col("path"))))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources: those of bad quality have failed, toxic ones need OCR."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    status = F.when(F.col("quality") == 0, "failed").when(F.col("toxic") == 1, "needs_ocr").otherwise("ready")
    joined = d.select("doc_id", "source", "lang").join(labels, "doc_id", "left")
    return joined.select(F.col("doc_id").alias("id"), F.lit("doc").alias("kind"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("collection"), status.alias("status"), F.concat(F.lit("lang "), F.col("lang")).alias("detail"), F.timestamp_seconds(F.col("doc_id") * 60).alias("created_at"))


def _search(spark: SparkSession, sf_dir: str, texts: Sequence[str], k: int = TOP) -> DataFrame:
    return fts.text_search(table(spark, sf_dir, "documents"), [parse_query(t) for t in texts], k, "doc_id", "text")


def fts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, [Q_WORDS])


def fts_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, [Q_NEGATED])


def fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, [Q_PHRASE])


def fts_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, [Q_OR])


def fts_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words that must both be there, by the shortest stretches that have both."""
    return _search(spark, sf_dir, [Q_COVER])


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings of the documents in a file, by term and block, their bounds in another, and the ids."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    folder = engine_queries.shared_folder(spark)
    made = fts.postings(docs, ["doc_id"], {"text": 1.0}).withColumn("block", blocks.block_of("doc_id"))
    made.write.options(**WRITTEN).parquet(f"{folder}/postings")
    posted = spark.read.schema(made.schema).parquet(f"{folder}/postings")
    blocks.bounds_in_place(posted).write.options(**WRITTEN).parquet(f"{folder}/bounds")
    return posted, spark.read.parquet(f"{folder}/bounds"), docs.select("doc_id")


def fts_stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fts_topk's rows, from stored postings, of which only blocks that can give a row are read."""
    return blocks.bounded_search(*_stored(spark, sf_dir), [parse_query(Q_WORDS)], TOP, "doc_id")


#: Alternatives of negated words, which rows without any of the words satisfy, too.
Q_WITHOUT = ("-the", "which or -of", '"of the" or -that', "-the -of -and", "the or from -that")


def fts_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negated alternatives by stored postings."""
    return blocks.bounded_search(*_stored(spark, sf_dir), [parse_query(q) for q in Q_WITHOUT], 40, "doc_id")


def best_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the stretch with most of the query's words begins in every document that has one, and how many it has."""
    wanted = set(parse_query(Q_WORDS).words)

    @F.pandas_udf("array<int>")
    def best(texts: pd.Series) -> pd.Series:
        def one(words: Sequence[str]) -> list[int] | None:
            hits = [(i, {w}) for i, w in enumerate(words) if w in wanted]
            found = fts.stretches(hits, len(words), 1, least=0)
            inside = [w for i, t in hits for w in t if found and found[0][0] <= i < found[0][1]]
            return [*found[0], len(set(inside)), len(inside)] if found else None

        return texts.map(lambda w: None if w is None else one(list(w)))

    made = table(spark, sf_dir, "documents").select("doc_id", best(words_of(F.col("text"))).alias("b")).where("b IS NOT NULL")
    return made.select("doc_id", *[F.get("b", F.lit(i)).cast("long").alias(n) for i, n in enumerate(("start", "stop", "terms", "hits"))])


def fts_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stemmed words; stop words are left out of the query and the texts."""
    return fts.text_search(table(spark, sf_dir, "documents"), [parse_query(Q_STEMMED, "english")], TOP, "doc_id", "text", "english")


def _matched(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return fts.scored(table(spark, sf_dir, "documents"), [parse_query(text)], "doc_id", "text")


def fts_terms_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, Q_WORDS).groupBy("terms").agg(F.count("*").alias("docs"))


def fts_exact_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, Q_WORDS).select("doc_id", "exact")


def postings_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and total frequency of every term."""
    return fts.term_statistics(table(spark, sf_dir, "documents"), "text")


SKILL_WORDS = ("steel", "brass", "1", "3")
WEIGHTS = {"name": 1.0, "description": 0.4}


def skill_discovery_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.concat_ws(" ", "p_brand", "p_type").alias("description"))
    posted = fts.postings(part, ["p_partkey"], WEIGHTS)
    words = spark.createDataFrame([(0, w) for w in SKILL_WORDS], "query_id long, term string")
    found = fts.postings_search(posted.where(F.col("term").isin(*SKILL_WORDS)), words, "p_partkey", TOP)
    return found.select("p_partkey", "terms", F.round("density", 4).alias("density"), "rank")


def _queries(base: DataFrame) -> DataFrame:
    return base.where(F.col("vec_id") % EVERY == 0)


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "embeddings")
    return vectors.nearest(base, _queries(base), TOP)


def vector_max_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "embeddings")
    return vectors.nearest(base, _queries(base), TOP, max_distance=0.7)


def vector_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "embeddings")
    return vectors.nearest(base.where(F.col("label") == 1), _queries(base), TOP)


def vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many queries there are, and whether the inverted file finds at least 0.9 of their true neighbours."""
    base = table(spark, sf_dir, "embeddings")
    found = vectors.nearest_cells(base, _queries(base), TOP).select("query_id", "vec_id", F.lit(1).alias("hit"))
    true = vectors.nearest(base, _queries(base), TOP).select("query_id", "vec_id")
    both = true.join(found, ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))


def quantized_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches by stored codes of each kind, alone and with exact distances for the candidates, against the exact search."""
    base = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked, folder, k = _queries(base), engine_queries.shared_folder(spark), 5
    true = vectors.nearest(base, asked, k + 1)
    parts = []
    for kind in ("float", "half", "int8", "binary"):
        vectors.coded_vectors(base, kind).write.parquet(f"{folder}/{kind}")
        codes = spark.read.schema("vec_id long, code binary").parquet(f"{folder}/{kind}")
        size = codes.agg(F.max(F.octet_length("code")).cast("long").alias("bytes"))
        for exact, found in ((False, vectors.nearest_codes(codes, asked, k + 1, kind)), (True, vectors.nearest_by_codes(codes, base, asked, k + 1, kind))):
            parts.append(vectors.compared_storage(true, found, k).crossJoin(F.broadcast(size)).select(F.lit(kind).alias("storage"), F.lit(exact).alias("exact"), "bytes", "recall", "mrr"))
    return reduce(DataFrame.unionByName, parts)


def _lists(spark: SparkSession, sf_dir: str, texts: Sequence[str], vec_ids: Sequence[int]) -> DataFrame:
    """Ranked lists (list, id, rank) of text queries and query vectors over one space of ids."""
    base = table(spark, sf_dir, "embeddings")
    words = _search(spark, sf_dir, texts, PER_QUERY).select(F.concat(F.lit("fts:"), F.col("query_id")).alias("list"), F.col("doc_id").alias("id"), "rank")
    near = vectors.nearest(base, base.where(F.col("vec_id").isin(*vec_ids)), PER_QUERY)
    place = reduce(lambda c, p: c.when(F.col("query_id") == p[1], F.lit(f"vec:{p[0]}")), enumerate(vec_ids), F.when(F.lit(False), ""))
    return words.unionByName(near.select(place.alias("list"), F.col("vec_id").alias("id"), "rank"))


def _fused(lists: DataFrame, limit: int) -> DataFrame:
    out = fusion.fuse(lists, "id").limit(limit)
    return out.select("id", F.round("score", 6).alias("score"), "best", F.array_join("lists", ",").alias("via"))


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(_lists(spark, sf_dir, [Q_WORDS], [7]), TOP)


def multi_query_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(_lists(spark, sf_dir, [Q_WORDS, Q_OTHER], [7, 11]), PER_QUERY)


def rrf_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal scores and best ranks: the key as text decides, so 10 comes before 9."""
    lists = _lists(spark, sf_dir, [Q_WORDS], [7]).withColumn("rank", F.ceil(F.col("rank") / 10).cast("long"))
    order = Window.orderBy(F.desc("score"), "best", F.col("id").cast("string"))  # at most 2 * PER_QUERY rows
    return _fused(lists, 2 * PER_QUERY).withColumn("place", F.row_number().over(order).cast("long"))


def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir, [Q_WORDS], [7]).select("id").distinct()


def _hits(spark: SparkSession, sf_dir: str) -> list:
    lists = _lists(spark, sf_dir, [Q_WORDS, Q_OTHER], [7, 11])
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return lists.join(docs, "id").orderBy("list", "rank").collect()


def hybrid_diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: lists, fusion, turns.  The driver sees at most 4 * PER_QUERY candidates."""
    lists: dict[str, list[fusion.Hit]] = {}
    for r in _hits(spark, sf_dir):
        lists.setdefault(r["list"], []).append(fusion.Hit(r.id, zlib.crc32((r.source or "").encode()), r.text or ""))
    chosen = fusion.diversify(lists, 2, TOP)
    return spark.createDataFrame([(i, h.chunk_id, round(h.score, 6)) for i, h in enumerate(chosen, 1)], "place long, id long, score double")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among a query's best results, pairs that say nearly the same.  There are at most PER_QUERY results."""
    best = _search(spark, sf_dir, [Q_WORDS], PER_QUERY).select("doc_id")
    docs = table(spark, sf_dir, "documents").join(F.broadcast(best), "doc_id").select("doc_id", F.array_distinct(words_of(F.col("text"))).alias("w"))
    a, b = docs.select(F.col("doc_id").alias("a"), F.col("w").alias("wa")), docs.select(F.col("doc_id").alias("b"), F.col("w").alias("wb"))
    share = F.size(F.array_intersect("wa", "wb")) / F.least(F.size("wa"), F.size("wb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(share, 6).alias("share")).where(F.col("share") > fusion.OVERLAP)


def near_duplicates_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of one source that say nearly the same: pairs of different sets of words, and each copy with the first of its set."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words_of(F.col("text")).alias("w"))
    pairs, members = containment.contained_pairs(docs, "doc_id", "w", "source", fusion.OVERLAP, f"{engine_queries.shared_folder(spark)}/sets")
    copies = members.where("doc_id <> class").select(F.col("class").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("share"))
    return pairs.select("a", "b", F.round("share", 6).alias("share")).union(copies)


def per_document_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a query's results at most three of a collection, the best."""
    best = _search(spark, sf_dir, [Q_WORDS], 100)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    within = Window.partitionBy("source").orderBy("rank")
    return docs.join(F.broadcast(best), "doc_id").withColumn("place", F.row_number().over(within).cast("long")).where(F.col("place") <= fusion.PER_DOCUMENT).select("source", "doc_id", "rank", "place")


GREP = "^The .* and "


def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.grep_candidates(nodes(spark, sf_dir), GREP, ignore_case=False)
    return files.grep_lines(found, GREP, ignore_case=False)


def grep_ignore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.grep_lines(files.grep_candidates(nodes(spark, sf_dir), GREP), GREP)


def grep_path_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.grep_lines(files.grep_candidates(nodes(spark, sf_dir), GREP, "/docs/src1/en/*.md"), GREP)


GREP_AFTER = (100, 1)


def grep_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.grep_candidates(nodes(spark, sf_dir), GREP, after=GREP_AFTER)
    window = found.orderBy("id").limit(files.GREP_FILES)
    return files.grep_lines(window, GREP, after=GREP_AFTER).orderBy("node_id", "line").limit(60)


def grep_file_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page looks at: files, the last of them, whether there are more."""
    window = files.grep_candidates(nodes(spark, sf_dir), "the").orderBy("id").limit(files.GREP_FILES + 1).select("id")
    head = window.orderBy("id").limit(files.GREP_FILES)
    return head.agg(F.count("*").alias("scanned_files"), F.max("id").alias("last_node_id")).join(window.agg((F.count("*") > files.GREP_FILES).alias("has_more_files")))


def _glob(pattern: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = files.with_path(nodes(spark, sf_dir)).where(files.in_glob(files.plan_glob(pattern)))
        return found.select(F.col("vfs_path").alias("path"), "uri", "role", "size_bytes")

    return run


GLOBS = {"glob_single_star": "/docs/src1/*/7*.md", "glob_double_star": "/docs/**/*5.md", "glob_braces": "/docs/*/{en,fr}/1?.md", "glob_class": "*[!0-8].md"}


def glob_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.glob(nodes(spark, sf_dir), "/docs/src[0-3]/**", limit=50, offset=25)


def ls_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.root_counts(sources(spark, sf_dir))


def ls_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.collections(sources(spark, sf_dir))


def ls_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.children(nodes(spark, sf_dir), "doc", "src2")


def ls_children_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.children(nodes(spark, sf_dir), "doc", "src2", "de")


def _chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for chunks."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.size(F.split("text", "\n")).cast("long").alias("n"))


def catalog_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.collection_rollup(sources(spark, sf_dir), _chunk_counts(spark, sf_dir))


def catalog_top_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.top_titles(sources(spark, sf_dir))


def catalog_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.problems(sources(spark, sf_dir))


def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every source: files, lines, embedded."""
    made = nodes(spark, sf_dir)
    cut = files.lines(made, [F.col("id").alias("source_id")], "content")
    embedded = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source_id"), "embedding")
    out = catalog.source_report(sources(spark, sf_dir), made.select(F.col("id").alias("source_id")), cut, embedded)
    return out.select(F.col("source_id").alias("id"), "collection", "name", "status", "files", "chunks", "embedded")


def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.status_counts(sources(spark, sf_dir))


def resource_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the index, pages as skills, and documents, in this order."""
    index = spark.createDataFrame([(0, "", "ctx://index", "catalog")], "grp int, sort string, uri string, name string")
    pages = table(spark, sf_dir, "pages").select(F.lit("skill_md").alias("role"), F.col("url").alias("name"), F.col("url").alias("path"), F.col("url").alias("uri"))
    docs = nodes(spark, sf_dir).select("role", "name", "path", "uri")
    return files.resource_page(index, pages.unionByName(docs), 100, 100).select("grp", "sort", "uri")


def uri_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", encoded(F.col("url")).alias("encoded"))


def vfs_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return n.select("id", source_path(F.col("kind"), F.col("name"), F.col("collection"), F.col("path")).alias("path"), "uri")


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


def ingest_dedup_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each text, the first."""
    return content_hash(spark, sf_dir).groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def _revised(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What was ingested, and what comes now: some texts changed, some documents new."""
    d = table(spark, sf_dir, "documents")
    current = d.where("doc_id % 10 <> 3").select(F.col("doc_id").alias("id"), F.lit("doc").alias("kind"), F.col("source").alias("collection"), F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("content_hash"), F.when(F.col("doc_id") % 11 == 0, "failed").otherwise("ready").alias("status"), F.lit("file").alias("origin_uri"))
    text = F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    incoming = d.select(F.lit("doc").alias("kind"), F.col("source").alias("collection"), F.col("doc_id").cast("string").alias("name"), F.sha2(text, 256).alias("content_hash"), F.lit("ready").alias("status"))
    return current, incoming


def ingest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, incoming = _revised(spark, sf_dir)
    return ingest.compared(incoming, current).select("collection", "name", "change")


def ingest_last_of_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several files of one name: the last stays."""
    d = table(spark, sf_dir, "documents")
    incoming = d.select(F.lit("doc").alias("kind"), F.col("source").alias("collection"), (F.col("doc_id") % 40).cast("string").alias("name"), F.concat(F.lit("file:/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("origin_uri"), F.sha2("text", 256).alias("content_hash"))
    return ingest.last_of_name(incoming).where("NOT superseded").select("collection", "name", "origin_uri")


def rename_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document has come under another name, too; of these the files of even ids are still there."""
    current, incoming = _revised(spark, sf_dir)
    origin = F.concat(F.lit("file:/in/"), F.col("name"))
    moved = incoming.where(F.col("name").cast("long") % 7 == 0).withColumn("name", F.concat("name", F.lit("-moved")))
    there = current.where("id % 2 = 0").select(origin.alias("path"))
    gone = ingest.renamed(ingest.twins(moved, current.withColumn("origin_uri", origin)), there)
    return gone.join(moved, ["collection", "content_hash"]).select("collection", "name", "old_name")


def distinct_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths for two thirds of the documents, next to the stored paths of the others."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("collection"), F.concat(F.col("lang"), (F.col("n_chars") % 50).cast("string"), F.when(F.col("doc_id") % 2 == 0, ".md").otherwise("")).alias("name"))
    stored = d.where("id % 3 = 0").select("collection", F.concat(F.regexp_replace("name", r"\.md$", ""), F.when(F.col("id") % 2 == 0, ".md").otherwise(F.concat(F.lit("-"), (F.col("id") % 4).cast("string"), F.lit(".md")))).alias("path")).distinct()
    return ingest.distinct_paths(d.where("id % 3 <> 0"), stored).select("id", "path")


def chunk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each turn those beside it."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("node_id"), F.col("turn").alias("ord"), "role")
    return files.neighbours_of(c, c).select("node_id", "ord", "near", "role")


def read_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("node_id"), F.col("turn").alias("ord"), "role", "text")
    return files.neighbours(c, 12, 3)


def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = files.lines(table(spark, sf_dir, "documents"), [F.col("doc_id")], "text")
    return cut.select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), F.length("raw").cast("long").alias("chars"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = files.lines(table(spark, sf_dir, "documents"), [F.col("doc_id")], "text", r"\n[ \t]*\n")
    return cut.select("doc_id", F.col("pos").cast("long").alias("pos"), F.sha2(F.trim("raw"), 256).alias("hash"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.chunked(table(spark, sf_dir, "documents"), "doc_id", "text")


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.chunk_sizes(table(spark, sf_dir, "documents"), "doc_id", "text")


def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document whether it has chunks, and whether these are numbered from 0 on and none is empty or much too large."""
    d = table(spark, sf_dir, "documents")
    c = chunk_documents(spark, sf_dir)
    whole = c.groupBy("node_id").agg(F.count("*").alias("n"), F.max("ord").alias("last"), F.count_distinct("ord").alias("ords"), F.min(F.length(F.trim("content"))).alias("least"), F.max("token_count").alias("most"))
    fine = (F.col("last") == F.col("n") - 1) & (F.col("ords") == F.col("n")) & (F.col("least") > 0) & (F.col("most") <= 1.5 * TARGET)
    return d.select("doc_id").join(whole, F.col("doc_id") == F.col("node_id"), "left").select("doc_id", F.col("n").isNotNull().alias("chunked"), F.coalesce(fine, F.lit(True)).alias("fine"))


def html_title_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h1"))


def html_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def markdown(html: pd.Series) -> pd.Series:
        return html.map(html_to_markdown)

    return table(spark, sf_dir, "pages").select("page_id", markdown("html").alias("markdown"))


def eval_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 5 and reciprocal rank of rows with the query's label, of every query."""
    base = table(spark, sf_dir, "embeddings")
    label = base.select("vec_id", "label")
    size = label.groupBy("label").agg(F.count("*").alias("expected"))
    found = vectors.nearest(base, _queries(base), TOP).join(label, "vec_id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    hit = F.col("label") == F.col("wanted")
    per = found.groupBy("query_id", "wanted").agg(F.count_if(hit & (F.col("rank") <= 5)).alias("hits"), F.min(F.when(hit, F.col("rank"))).alias("first"))
    return per.join(size, per.wanted == size.label).select("query_id", F.round(F.col("hits") / F.col("expected"), 6).alias("recall5"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def completion_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.completions(table(spark, sf_dir, "documents"), "source", "SRC1")


def changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of what changed since a version: users with events, the version is the day."""
    e = table(spark, sf_dir, "events")
    log = e.select(F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("version"), F.concat(F.lit("ctx://docs/users/"), F.col("user_id").cast("string")).alias("uri"))
    return changed_since(log, 18, "ctx://docs/users/2", 50)


def subscription_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of changes, made of the documents, as a stream to those who subscribed: one notice for each version of an address."""
    docs, folder = table(spark, sf_dir, "documents"), engine_queries.shared_folder(spark)
    uri = F.concat(F.lit("ctx://docs/"), F.col("source"), F.lit("/"), (F.col("doc_id") % 7).cast("string"))
    log = docs.select(F.floor(F.col("doc_id") / 40).cast("long").alias("version"), uri.alias("uri"), F.lit("written").alias("change"), F.lit(None).cast("timestamp").alias("committed_at"))
    log.coalesce(1).write.parquet(f"{folder}/changes")
    wanted = docs.where("doc_id % 3 = 0").select(F.col("lang").alias("subscriber"), uri.alias("uri")).distinct()
    stream = spark.readStream.schema(log.schema).parquet(f"{folder}/changes")
    kept_running(lambda: write_notices(stream, wanted, f"{folder}/notices", f"{folder}/checkpoint"))
    return spark.read.schema(NOTICES).parquet(f"{folder}/notices")


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.json_rows(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))


def vector_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's distance to one of them."""
    base = table(spark, sf_dir, "embeddings")
    one = base.where("vec_id = 7").select(F.col("embedding").alias("q"))  # one row
    return base.join(F.broadcast(one)).select("vec_id", (F.round(vectors.cosine_distance(F.col("embedding"), F.col("q")), 6) + F.lit(0.0)).alias("distance"))


def vfs_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready sources of one collection."""
    return scoped(sources(spark, sf_dir), "docs/src3").select("id", "name")


def uri_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of documents, built and read back."""
    @F.pandas_udf("string")
    def root(uris: pd.Series) -> pd.Series:
        return uris.map(lambda u: parse_uri(u).root)

    @F.pandas_udf("string")
    def path(uris: pd.Series) -> pd.Series:
        return uris.map(lambda u: parse_uri(u).path)

    return nodes(spark, sf_dir).select("id", root("uri").alias("root"), path("uri").alias("path"))


def text_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginnings of texts, ended at a word."""
    @F.pandas_udf("string")
    def clipped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else clip(t, 80))

    return table(spark, sf_dir, "documents").select("doc_id", clipped("text").alias("clip"))


def conservative_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: conservative_tokens(t or ""))

    return table(spark, sf_dir, "documents").select("doc_id", tokens("text").alias("tokens"))


def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a deterministic embedder: each has the length of one, but for texts without words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = vectors.embed_rows(docs, vectors.HashEmbedder(64), "text")
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return made.select("doc_id", F.size("embedding").cast("long").alias("dims"), F.round(squares, 3).alias("squares"), F.col("embed_error").isNull().alias("fine"))


def dense_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers for all documents: each once, from 101 on."""
    n = number_rows(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 100)
    return n.agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count_distinct("id").alias("numbers"))


def result_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search's links, one for each collection, in the order of its best result."""
    best = _search(spark, sf_dir, [Q_WORDS], 100)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("uri"))
    return fusion.distinct_links(docs.join(F.broadcast(best), "doc_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        fts_topk, fts_cover, fts_stored_postings, fts_without, best_fragments, fts_english, vector_cells, quantized_recall, vector_distance, vfs_scope, uri_decoded, text_clips, conservative_estimates,
        embed_batches, dense_numbers, result_links, ingest_last_of_name, chunk_bounds, fts_terms_coverage, fts_exact_flag, fts_negation, fts_phrase, fts_or, postings_terms, skill_discovery_weighted, vector_topk,
        vector_max_distance, vector_scoped, hybrid_rrf, multi_query_rrf, rrf_tiebreak, candidate_union, hybrid_diversified, near_duplicates, near_duplicates_all,
        per_document_cap, grep_lines, grep_ignore_case, grep_path_glob, grep_keyset_page, grep_file_window, glob_page, ls_root, ls_collections,
        ls_children, ls_children_deep, catalog_collections, catalog_top_titles, catalog_problems, source_report, status_histogram,
        resource_list_page, uri_encode, vfs_path, token_estimates, content_hash, ingest_dedup_by_hash, ingest_diff, rename_reclaim,
        distinct_paths, chunk_neighbours, read_window, lines_explode, paragraphs, chunk_documents, chunk_stats, html_title_h1, html_normalize,
        eval_recall_mrr, completion_prefix, changes_since, subscription_notices, json_rows,
    )
} | {name: _glob(pattern) for name, pattern in GLOBS.items()} | engine_queries.QUERIES | function_queries.QUERIES
