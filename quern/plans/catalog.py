"""The engine's queries over the driver's tables, and DuckDB SQL with the same results.

`documents` stands for files: its source is the codebase, and language, id and an
extension make the path. `embeddings` holds the vector of the document of the same id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text, vector
from quern.operators import knn, registry, tables, vector_index
from quern.sources.store import shared_dir

EXTENSIONS = [
    ".py", ".go", ".ts", ".TSX", ".h", ".cxx", ".yml", ".md", ".zsh", ".xyz", ".PNG", ".db", ".rb", ".html", "",
    ".js", ".jsx", ".java", ".rs", ".c", ".cpp", ".hpp", ".cc", ".php", ".swift", ".kt", ".scala", ".cs", ".sh", ".bash", ".sql", ".yaml", ".json", ".toml", ".xml", ".htm", ".css", ".scss", ".less",
    ".pdf", ".tar.gz", ".woff2", ".class", ".so", ".Zip", ".mp4", ".md.bak", ".pyc",
]
MODEL, DIMS = "model-a", 64
K, QUERY_ID = 10, 7


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*(F.lit(x) for x in EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), ext)
    return _read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("codebase"), path.alias("file_path"), F.col("doc_id").cast("double").alias("last_modified"), F.col("text").alias("content"), "lang", "n_chars")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per document that has a vector."""
    vectors = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    one = files(spark, sf_dir).join(vectors, "doc_id")
    return one.select(
        "doc_id", "codebase", "file_path", "lang", "content", "embedding", F.lit(0).alias("chunk_index"), F.lit(1).alias("start_line"), F.size(text.lines_of("content")).alias("end_line"),
        F.when(F.col("label") % 2 == 0, F.concat(F.lit("sym"), F.col("label").cast("string"))).otherwise("").alias("symbol_name"), F.when(F.col("label") % 3 == 0, "function").otherwise("block").alias("chunk_type"),
    )


def codebases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source; a third has another model, every fifth is deprecated."""
    n = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    by = _read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").cast("int").alias("files"), F.max("doc_id").alias("last"))
    return by.select(
        F.concat(F.lit("/"), "source").alias("root"), F.lit("g1").alias("generation"), F.when(n % 3 == 1, "model-b").when(n % 7 == 0, "").otherwise(MODEL).alias("model"), F.lit(DIMS).alias("dims"),
        "files", (F.col("files") * 2).alias("chunks"), F.timestamp_seconds("last").alias("last_indexed"), F.when(n % 5 == 4, "deprecated").otherwise("active").alias("status"),
        F.lit(None).cast("timestamp").alias("deprecated_at"), F.lit(None).cast("string").alias("deprecated_reason"),
    )


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return _read(spark, sf_dir, "embeddings").filter(F.col("vec_id") == QUERY_ID).select("embedding").head()[0]


def _hits(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "file_path", vector.score(F.col("similarity")).alias("score"))


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = knn.nearest(vectors, query_vector(spark, sf_dir), K, ties=("vec_id",))
    return found.select("vec_id", vector.score(F.col("similarity")).alias("score"))


def knn_join_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top k of the vectors first, then their documents: the join sees k rows on one side, and texts of k rows only."""
    vectors = _read(spark, sf_dir, "embeddings").join(_read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    top = knn.nearest(vectors, query_vector(spark, sf_dir), K, ties=("vec_id",)).select(F.col("vec_id").alias("doc_id"), "similarity")
    return knn.shaped(chunks(spark, sf_dir).join(F.broadcast(top), "doc_id"))  # K rows


def knn_verbose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.shaped(knn.nearest(chunks(spark, sf_dir), query_vector(spark, sf_dir), K), verbose=True).select("file", F.octet_length("snippet").cast("int").alias("bytes"), F.md5("snippet").alias("digest"))


def knn_area_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(knn.nearest(chunks(spark, sf_dir), query_vector(spark, sf_dir), K, where=knn.under("/src3")))


def knn_area_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(knn.nearest(chunks(spark, sf_dir), query_vector(spark, sf_dir), 60, where=knn.under("/src3"), mode="post"))


def knn_exclude_deprecated(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = chunks(spark, sf_dir).withColumn("root", F.concat(F.lit("/"), "codebase"))
    live = knn.without_deprecated(named, codebases(spark, sf_dir), codebase="root")
    return _hits(knn.nearest(live, query_vector(spark, sf_dir), K))


def knn_all_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(knn.nearest_per_codebase(chunks(spark, sf_dir), query_vector(spark, sf_dir), 3))


def knn_most_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    (root,) = registry.resolved(codebases(spark, sf_dir), MODEL, DIMS)
    return _hits(knn.nearest(chunks(spark, sf_dir), query_vector(spark, sf_dir), K, where=F.concat(F.lit("/"), "codebase") == root))


def knn_all_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = registry.resolved(codebases(spark, sf_dir), MODEL, DIMS, all_=True)
    return _hits(knn.nearest(chunks(spark, sf_dir), query_vector(spark, sf_dir), K, where=F.concat(F.lit("/"), "codebase").isin(roots)))


def knn_language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: filters on language and chunk type."""
    return _hits(knn.nearest(chunks(spark, sf_dir), query_vector(spark, sf_dir), K, where=(F.col("lang") == "en") & (F.col("chunk_type") == "function")))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of the searches for many: every vector whose id is divisible by 100."""
    return _read(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 100 == 0)


def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors to every vector whose id is divisible by 100, exact."""
    found = knn.nearest_of_each(_read(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 5, "vec_id")
    return found.select("query", F.col("rank").cast("long").alias("rank"), F.col("id").alias("vec_id"), vector.score(F.col("similarity")).alias("score"))


def knn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest to every vector whose id is divisible by 100, by an index of all vectors that is stored and opened again; approximate."""
    path = f"{shared_dir(spark)}/quern-index-{uuid.uuid4().hex}"
    vector_index.build(_read(spark, sf_dir, "embeddings"), path, "vec_id")
    found = vector_index.VectorIndex(spark, path).search(_asked(spark, sf_dir), K, "vec_id")
    return found.select("query", F.col("rank").cast("long").alias("rank"), F.col("id").alias("vec_id"), vector.score(F.col("similarity")).alias("score"))


def find_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: chunks like a given chunk, itself left out."""
    found = knn.nearest(chunks(spark, sf_dir), query_vector(spark, sf_dir), K, where=F.col("doc_id") != QUERY_ID)
    return _hits(found)


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return _read(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.norm(v), 4).alias("norm"), F.round(vector.dot(v, v), 4).alias("dot"))


def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = files(spark, sf_dir).select("doc_id", F.explode_outer(text.line_windows("content")).alias("c")).filter("c is not null")
    return out.select("doc_id", "c.chunk_index", "c.start_line", "c.end_line", F.md5("c.content").alias("digest"))


def chunk_sub_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a node that starts at line doc_id % 100, small enough to overlap often."""
    out = files(spark, sf_dir).select("doc_id", F.explode_outer(text.line_windows("content", 6, 2, (F.col("doc_id") % 100).cast("int"))).alias("c")).filter("c is not null")
    return out.select("doc_id", "c.start_line", "c.end_line", F.md5("c.content").alias("digest"))


def join_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text.lines_of("content")
    return files(spark, sf_dir).select("doc_id", F.md5(text.join_lines(lines, 2, 5)).alias("middle"), F.md5(text.join_lines(lines, -3, 2)).alias("head"))


def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", text.extension("file_path").alias("ext"), text.detect_language("file_path").alias("language"))


def fence_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", text.fence_language("file_path").alias("fence"))


def binary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter(~text.is_binary("file_path")).select("doc_id", "file_path")


def size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter(text.within_size("content", 2)).select("doc_id", F.octet_length("content").cast("long").alias("bytes"))


def file_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", text.content_hash("content").alias("file_hash"))


def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbol = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("f"), F.col("doc_id").cast("string"))).otherwise("")
    full = text.embedding_text("file_path", text.detect_language("file_path"), symbol, F.lit("function"), F.lit(1), F.size(text.lines_of("content")), "content")
    return files(spark, sf_dir).select("doc_id", F.md5(full).alias("digest"), F.length(full).alias("length"))


def truncate_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", F.md5(text.cut_bytes("content", 1000)).alias("digest"))


def snippet_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", text.snippet_preview("content").alias("snippet"))


def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", text.slugify("content").alias("slug"))


def markdown_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/notes/"), F.col("doc_id").cast("string"), F.lit(".MD"))).otherwise("/notes/")
    return files(spark, sf_dir).select("doc_id", text.markdown_path(out, "content").alias("path"))


def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", text.human_size(F.col("n_chars") * F.col("n_chars") * F.col("doc_id")).alias("size"))


def storage_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.concat(F.lit("/a b/"), "content")
    return files(spark, sf_dir).select("doc_id", text.storage_name(root).alias("name"), text.archive_name(F.col("codebase"), F.lit("m:x y"), F.col("doc_id")).alias("archive"))


def markdown_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks(spark, sf_dir)
    score = F.round((F.col("doc_id") % 977) / 977, 4)
    return found.select("doc_id", F.md5(text.markdown_hit("file_path", "start_line", "end_line", score, "symbol_name", "chunk_type", "content")).alias("digest"))


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files indexed before: two of three, of which every fourth has changed since."""
    old = files(spark, sf_dir).filter(F.col("doc_id") % 3 != 0)
    return old.select("file_path", F.when(F.col("doc_id") % 4 == 0, F.col("last_modified") - 1).otherwise(F.col("last_modified")).alias("last_modified"))


def incremental_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.changed(files(spark, sf_dir), _indexed(spark, sf_dir)).select("doc_id", "file_path")


def incremental_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.unchanged(files(spark, sf_dir), _indexed(spark, sf_dir)).agg(F.count("*").alias("files_skipped"))


def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as chunks of orders; the lines of every third order are written again, those with a discount failed to embed."""
    items = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_path"), F.col("l_linenumber").alias("chunk_index"), F.col("l_quantity").alias("v"), "l_discount")
    new = items.filter((F.col("file_path") % 3 == 0) & (F.col("l_discount") < 0.05)).withColumn("v", F.col("v") + 1000)
    return tables.replaced(items.drop("l_discount"), new.drop("l_discount"))


def drop_null_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    all_ = files(spark, sf_dir).join(vectors, "doc_id", "left")
    return tables.embedded(all_).groupBy("codebase").agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("chunks"))


def prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.prefix_counts(files(spark, sf_dir), chunks(spark, sf_dir), "/src1")


def cascade_delete_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.without_prefix(files(spark, sf_dir), "/src1").select("doc_id", "file_path")


def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.batches(files(spark, sf_dir).select("doc_id"), 50, "doc_id")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = F.when(F.col("event_type") == "click", F.array(F.struct(F.col("event_type").alias("file"), F.col("user_id").cast("string").alias("error"))))
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.concat(F.lit("/u"), F.col("user_id").cast("string")).alias("directory"), F.col("ts").alias("finished_at"), errors.alias("error_details"))


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.latest_run(_runs(spark, sf_dir)).select("run_id", "directory")


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.status(files(spark, sf_dir), chunks(spark, sf_dir), _runs(spark, sf_dir))
    return out.select("files", "chunks", "run_id", F.size("error_details").alias("errors"))


def run_error_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error lists survive as JSON and back."""
    runs = _runs(spark, sf_dir).filter("error_details is not null").withColumn("json", F.to_json("error_details"))
    back = F.from_json("json", "array<struct<file:string,error:string>>")
    return runs.select("run_id", "json", F.get(back, F.lit(0))["error"].alias("error"))


def codebase_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.rollup(codebases(spark, sf_dir))


def codebase_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.listed(codebases(spark, sf_dir), all_=True).select("root", "status", F.unix_timestamp("last_indexed").alias("last_indexed"))


def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = codebases(spark, sf_dir)
    new = all_.filter(F.col("root").rlike("4$")).withColumn("files", F.col("files") + 1)
    return registry.upserted(all_, new).select("root", "files", "status")


def registry_deprecate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.deprecated(codebases(spark, sf_dir), F.col("root").isin("/src2", "/src4"), "removed", F.timestamp_seconds(F.lit(0))).select("root", "status", "deprecated_reason")


def registry_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.purged(codebases(spark, sf_dir)).select("root", "status")


def model_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebases(spark, sf_dir).select("root", registry.matches(MODEL, DIMS).alias("matches"), registry.mismatch_reason(MODEL, DIMS).alias("reason"))


def health_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.health(codebases(spark, sf_dir), MODEL, DIMS, F.col("files") % 2 == 0)


def resolve_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' addresses below registered sites and folders."""
    pages = _read(spark, sf_dir, "pages").select("page_id", F.split("url", "[?#]")[0].alias("path"))
    parts = F.split("path", "/")
    roots = pages.filter(F.col("page_id") % 2 == 0).select(F.array_join(F.slice(parts, 1, 3), "/").alias("root")).union(pages.filter(F.col("page_id") % 3 == 0).select(F.array_join(F.slice(parts, 1, 4), "/").alias("root")))
    return registry.longest_prefix(pages, roots).select("page_id", "root")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        knn_topk, knn_join_chunks, knn_verbose, knn_area_pre, knn_area_post, knn_exclude_deprecated, knn_all_merge, knn_most_recent, knn_all_matching, knn_language_filter, knn_batch, knn_index, find_similar, vector_norms,
        chunk_fixed, chunk_sub_offset, join_lines, detect_language, fence_language, binary_filter, size_filter, file_hash, embed_text, truncate_bytes, snippet_preview, slugify, markdown_path, human_size, storage_name, markdown_hit,
        incremental_changed, incremental_skipped, upsert_replace, drop_null_vectors, prefix_counts, cascade_delete_prefix, batch_assign, latest_run, status_counts, run_error_json,
        codebase_rollup, codebase_list, registry_upsert, registry_deprecate, registry_purge, model_match, health_counts, resolve_longest_prefix,
    )
}


# --- the same in SQL ---------------------------------------------------------

_EXT = "(['" + "','".join(EXTENSIONS) + f"'])[doc_id % {len(EXTENSIONS)} + 1]"
_FILES = f"files AS (SELECT doc_id, source AS codebase, '/' || source || '/' || lang || '/' || doc_id || {_EXT} AS file_path, CAST(doc_id AS DOUBLE) AS last_modified, text AS content, lang, n_chars FROM documents)"
_CHUNKS = f"""{_FILES}, q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = {QUERY_ID}),
chunks AS (SELECT doc_id, codebase, file_path, lang, content, len(string_split(content, chr(10))) AS end_line, CASE WHEN label % 2 = 0 THEN 'sym' || label ELSE '' END AS symbol_name,
  CASE WHEN label % 3 = 0 THEN 'function' ELSE 'block' END AS chunk_type, list_cosine_similarity(embedding::DOUBLE[], (SELECT q FROM q)) AS s FROM files JOIN embeddings ON vec_id = doc_id)"""
_N = "CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER)"
_CODEBASES = f"""codebases AS (SELECT '/' || source AS root, CASE WHEN {_N} % 3 = 1 THEN 'model-b' WHEN {_N} % 7 = 0 THEN '' ELSE '{MODEL}' END AS model, CAST(count(*) AS INTEGER) AS files, CAST(2 * count(*) AS INTEGER) AS chunks,
  max(doc_id) AS last_indexed, CASE WHEN {_N} % 5 = 4 THEN 'deprecated' ELSE 'active' END AS status FROM documents GROUP BY source)"""
_TOP = "SELECT doc_id, file_path, round(s, 4) AS score FROM {} ORDER BY s DESC, file_path LIMIT {}"
# spelled out, so that a wrong entry of the tables under test shows
_LANGUAGE = """CASE WHEN ext = '.py' THEN 'python' WHEN ext IN ('.js', '.jsx') THEN 'javascript' WHEN ext IN ('.ts', '.tsx') THEN 'typescript' WHEN ext = '.java' THEN 'java' WHEN ext = '.go' THEN 'go' WHEN ext = '.rs' THEN 'rust'
  WHEN ext IN ('.c', '.h') THEN 'c' WHEN ext IN ('.cpp', '.hpp', '.cc') THEN 'cpp' WHEN ext = '.rb' THEN 'ruby' WHEN ext = '.php' THEN 'php' WHEN ext = '.swift' THEN 'swift' WHEN ext = '.kt' THEN 'kotlin' WHEN ext = '.scala' THEN 'scala'
  WHEN ext = '.cs' THEN 'csharp' WHEN ext IN ('.sh', '.bash', '.zsh') THEN 'shell' WHEN ext = '.sql' THEN 'sql' WHEN ext = '.md' THEN 'markdown' WHEN ext IN ('.yaml', '.yml') THEN 'yaml' WHEN ext = '.json' THEN 'json'
  WHEN ext = '.toml' THEN 'toml' WHEN ext = '.xml' THEN 'xml' WHEN ext IN ('.html', '.htm') THEN 'html' WHEN ext = '.css' THEN 'css' WHEN ext = '.scss' THEN 'scss' WHEN ext = '.less' THEN 'less' ELSE '' END"""
_FENCE = """CASE WHEN ext IN ('.go', '.java', '.c', '.cpp') THEN substr(ext, 2) WHEN ext = '.py' THEN 'python' WHEN ext IN ('.js', '.jsx') THEN 'javascript' WHEN ext IN ('.ts', '.tsx') THEN 'typescript'
  WHEN ext = '.rs' THEN 'rust' WHEN ext = '.rb' THEN 'ruby' WHEN ext = '.h' THEN 'c' WHEN ext IN ('.cc', '.cxx', '.hpp') THEN 'cpp' WHEN ext IN ('.sh', '.bash') THEN 'bash' ELSE '' END"""
_BINARY = "regexp_matches(file_path, '(?i)\\.(png|jpe?g|gif|bmp|ico|webp|pdf|zip|tar|gz|bz2|xz|7z|rar|exe|dll|so|dylib|bin|woff2?|ttf|eot|otf|mp3|mp4|wav|avi|mov|flv|o|a|lib|class|jar|sqlite|db)$')"
_WITH_EXT = f"{_FILES}, e AS (SELECT *, regexp_extract(lower(file_path), '(\\.[^./]*)$', 1) AS ext FROM files)"
_BLANK = "regexp_full_match({}, '\\s*')"
_LIVE = f"model IN ('', '{MODEL}') AND status = 'active'"
_SNIPPET = """CASE WHEN len(l) > 3 OR length(array_to_string(l[1:3], chr(10))) > 160 THEN left(array_to_string(l[1:3], chr(10)), 160) || '…' ELSE array_to_string(l[1:3], chr(10)) END"""
_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


def _slug(x: str) -> str:
    s = _SLUG.format(x)
    return f"CASE WHEN {s} = '' THEN 'search' ELSE regexp_replace(left({s}, 60), '^-+|-+$', '', 'g') END"


def _hit(path: str) -> str:
    return f"""chr(10) || '### [' || {path} || ':1-' || end_line || '](' || {path} || '#L1-L' || end_line || ')' || chr(10) || chr(10) || 'Score: ' || printf('%.4f', round((doc_id % 977) / 977.0, 4)) || ' · Symbol: '
  || CASE WHEN symbol_name = '' THEN '—' ELSE symbol_name END || ' · Type: ' || chunk_type || chr(10) || chr(10) || '```' || {_FENCE} || chr(10) || rtrim(content, chr(10)) || chr(10) || '```' || chr(10)"""


def _windows(window: int, step: int, offset: str) -> str:
    return f"""WITH {_FILES}, l AS (SELECT doc_id, string_split(content, chr(10)) AS l FROM files WHERE NOT {_BLANK.format('content')}), s AS (SELECT doc_id, l, unnest(range(0, len(l), {step})) AS s FROM l)
SELECT doc_id, CAST(s // {step} AS INTEGER) AS chunk_index, CAST(s + 1 + {offset} AS INTEGER) AS start_line, CAST(least(s + {window}, len(l)) + {offset} AS INTEGER) AS end_line, md5(array_to_string(l[s + 1:s + {window}], chr(10))) AS digest FROM s"""


def _cut(table: str, most: int) -> str:
    """cut: table with at most so many bytes of content; of a character cut in two stays U+FFFD."""
    return f"""chars AS (SELECT doc_id, unnest(generate_series(1, least(length(content), {most}))) AS i, content FROM {table} WHERE strlen(content) > {most}),
sizes AS (SELECT doc_id, i, sum(strlen(substring(content, i, 1))) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM chars),
fit AS (SELECT doc_id, max(i) AS i, max(n) AS n FROM sizes WHERE n <= {most} GROUP BY doc_id),
cut AS (SELECT t.*, CASE WHEN fit.i IS NULL THEN content ELSE left(content, fit.i) || CASE WHEN fit.n < {most} THEN chr(65533) ELSE '' END END AS cut FROM {table} t LEFT JOIN fit ON fit.doc_id = t.doc_id)"""


_LARGE = "(n_chars * n_chars * doc_id)"
ORACLE_SQL: dict[str, str] = {
    "knn_topk": f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {QUERY_ID})), 4) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {QUERY_ID})) DESC, vec_id LIMIT {K}",
    "knn_join_chunks": f"WITH {_CHUNKS}, t AS (SELECT *, string_split(content, chr(10)) AS l FROM chunks ORDER BY s DESC, file_path LIMIT {K}) SELECT file_path AS file, '1-' || end_line AS lines, round(s, 4) AS score, symbol_name AS symbol, chunk_type AS type, {_SNIPPET} AS snippet FROM t",
    "knn_verbose": f"WITH {_CHUNKS}, t AS (SELECT * FROM chunks ORDER BY s DESC, file_path LIMIT {K}), {_cut('t', 500)} SELECT file_path AS file, CAST(strlen(cut) AS INTEGER) AS bytes, md5(cut) AS digest FROM cut",
    "knn_area_pre": f"WITH {_CHUNKS} " + _TOP.format("chunks WHERE starts_with(file_path, '/src3/')", K),
    "knn_area_post": f"WITH {_CHUNKS}, t AS (SELECT * FROM chunks ORDER BY s DESC, file_path LIMIT 60) SELECT doc_id, file_path, round(s, 4) AS score FROM t WHERE starts_with(file_path, '/src3/')",
    "knn_exclude_deprecated": f"WITH {_CHUNKS}, {_CODEBASES} " + _TOP.format("chunks c WHERE NOT EXISTS (SELECT 1 FROM codebases b WHERE b.status = 'deprecated' AND starts_with(c.file_path, b.root || '/'))", K),
    "knn_all_merge": f"WITH {_CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY codebase ORDER BY s DESC, file_path) AS rank FROM chunks) " + _TOP.format("r WHERE rank <= 3", 3),
    "knn_most_recent": f"WITH {_CHUNKS}, {_CODEBASES} " + _TOP.format(f"chunks WHERE '/' || codebase = (SELECT root FROM codebases WHERE {_LIVE} ORDER BY last_indexed DESC, root LIMIT 1)", K),
    "knn_all_matching": f"WITH {_CHUNKS}, {_CODEBASES} " + _TOP.format(f"chunks WHERE '/' || codebase IN (SELECT root FROM codebases WHERE {_LIVE})", K),
    "knn_language_filter": f"WITH {_CHUNKS} " + _TOP.format("chunks WHERE lang = 'en' AND chunk_type = 'function'", K),
    "knn_batch": """WITH s AS (SELECT a.vec_id AS query, b.vec_id, list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM s) SELECT query, rank, vec_id, round(s, 4) AS score FROM r WHERE rank <= 5""",
    "find_similar": f"WITH {_CHUNKS} " + _TOP.format(f"chunks WHERE doc_id <> {QUERY_ID}", K),
    "vector_norms": "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS dot FROM embeddings",
    "chunk_fixed": _windows(60, 50, "0"),
    "chunk_sub_offset": f"SELECT doc_id, start_line, end_line, digest FROM ({_windows(6, 4, 'doc_id % 100')})",
    "join_lines": f"WITH {_FILES}, l AS (SELECT doc_id, string_split(content, chr(10)) AS l FROM files) SELECT doc_id, md5(array_to_string(l[2:5], chr(10))) AS middle, md5(array_to_string(l[1:2], chr(10))) AS head FROM l",
    "detect_language": f"WITH {_WITH_EXT} SELECT doc_id, ext, {_LANGUAGE} AS language FROM e",
    "fence_language": f"WITH {_WITH_EXT} SELECT doc_id, {_FENCE} AS fence FROM e",
    "binary_filter": f"WITH {_FILES} SELECT doc_id, file_path FROM files WHERE NOT {_BINARY}",
    "size_filter": f"WITH {_FILES} SELECT doc_id, strlen(content) AS bytes FROM files WHERE strlen(content) <= 2048",
    "file_hash": f"WITH {_FILES} SELECT doc_id, sha256(content) AS file_hash FROM files",
    "embed_text": f"""WITH {_WITH_EXT}, t AS (SELECT doc_id, '# File: ' || file_path || chr(10) || '# Language: ' || CASE WHEN {_LANGUAGE} = '' THEN 'unknown' ELSE {_LANGUAGE} END || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '# Symbol: f' || doc_id || ' (function)' || chr(10) ELSE '' END
  || '# Lines: 1-' || len(string_split(content, chr(10))) || chr(10) || chr(10) || content AS t FROM e) SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS length FROM t""",
    "truncate_bytes": f"WITH {_FILES}, {_cut('files', 1000)} SELECT doc_id, md5(cut) AS digest FROM cut",
    "snippet_preview": f"WITH {_FILES}, t AS (SELECT doc_id, string_split(content, chr(10)) AS l FROM files) SELECT doc_id, {_SNIPPET} AS snippet FROM t",
    "slugify": f"WITH {_FILES} SELECT doc_id, {_slug('content')} AS slug FROM files",
    "markdown_path": f"WITH {_FILES} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '/notes/' || doc_id || '.MD' ELSE '/notes/' || {_slug('content')} || '.md' END AS path FROM files",
    "human_size": f"WITH {_FILES} SELECT doc_id, CASE WHEN {_LARGE} < 1024 THEN {_LARGE} || 'B' " + " ".join(f"WHEN {_LARGE} < {1024 ** (k + 1)} THEN printf('%.1f', {_LARGE} / {float(1024**k)}) || '{u}B'" for k, u in enumerate("KMGTP", 1)) + " END AS size FROM files",
    "storage_name": f"""WITH {_FILES}, s AS (SELECT *, regexp_replace(regexp_extract('/a b/' || content, '([^/]*)$', 1), '[^a-zA-Z0-9._-]+', '-', 'g') AS s FROM files)
SELECT doc_id, CASE WHEN s IN ('', '-') THEN 'codebase' ELSE s END || '-' || left(sha256('/a b/' || content), 8) AS name, codebase || '-deprecated-m-x-y-' || doc_id AS archive FROM s""",
    "markdown_hit": f"WITH {_CHUNKS}, e AS (SELECT *, regexp_extract(lower(file_path), '(\\.[^./]*)$', 1) AS ext FROM chunks) SELECT doc_id, md5({_hit('file_path')}) AS digest FROM e",
    "incremental_changed": f"WITH {_FILES} SELECT doc_id, file_path FROM files WHERE doc_id % 3 = 0 OR doc_id % 4 = 0",
    "incremental_skipped": f"WITH {_FILES} SELECT count(*) AS files_skipped FROM files WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0",
    "upsert_replace": """WITH i AS (SELECT l_orderkey AS file_path, l_linenumber AS chunk_index, l_quantity AS v, l_discount FROM lineitem), n AS (SELECT file_path, chunk_index, v + 1000 AS v FROM i WHERE file_path % 3 = 0 AND l_discount < 0.05)
SELECT file_path, chunk_index, v FROM i WHERE file_path NOT IN (SELECT file_path FROM n) UNION ALL SELECT * FROM n""",
    "drop_null_vectors": f"WITH {_FILES} SELECT codebase, count(DISTINCT file_path) AS files, count(*) AS chunks FROM files JOIN embeddings ON vec_id = doc_id WHERE embedding IS NOT NULL GROUP BY codebase",
    "prefix_counts": f"WITH {_CHUNKS} SELECT (SELECT count(*) FROM files WHERE starts_with(file_path, '/src1/')) AS files, (SELECT count(*) FROM chunks WHERE starts_with(file_path, '/src1/')) AS chunks",
    "cascade_delete_prefix": f"WITH {_FILES} SELECT doc_id, file_path FROM files WHERE NOT starts_with(file_path, '/src1/')",
    "batch_assign": "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 50 AS BIGINT) AS batch FROM documents",
    "latest_run": "SELECT event_id AS run_id, '/u' || user_id AS directory FROM events ORDER BY event_id DESC LIMIT 1",
    "status_counts": f"WITH {_CHUNKS}, r AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 1) SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM chunks) AS chunks, event_id AS run_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS errors FROM r",
    "run_error_json": """SELECT event_id AS run_id, '[{"file":"' || event_type || '","error":"' || user_id || '"}]' AS json, CAST(user_id AS VARCHAR) AS error FROM events WHERE event_type = 'click'""",
    "codebase_rollup": f"WITH {_CODEBASES} SELECT count(*) AS codebases, CAST(sum(files) AS BIGINT) AS files, CAST(sum(chunks) AS BIGINT) AS chunks FROM codebases WHERE status = 'active'",
    "codebase_list": f"WITH {_CODEBASES} SELECT root, status, last_indexed FROM codebases ORDER BY last_indexed DESC, root",
    "registry_upsert": f"WITH {_CODEBASES} SELECT root, CASE WHEN root LIKE '%4' THEN files + 1 ELSE files END AS files, CASE WHEN root LIKE '%4' THEN 'active' ELSE status END AS status FROM codebases",
    "registry_deprecate": f"WITH {_CODEBASES} SELECT root, CASE WHEN root IN ('/src2', '/src4') THEN 'deprecated' ELSE status END AS status, CASE WHEN root IN ('/src2', '/src4') AND status = 'active' THEN 'removed' END AS deprecated_reason FROM codebases",
    "registry_purge": f"WITH {_CODEBASES} SELECT root, status FROM codebases WHERE status <> 'deprecated'",
    "model_match": f"WITH {_CODEBASES} SELECT root, model IN ('', '{MODEL}') AS matches, CASE WHEN model IN ('', '{MODEL}') THEN '' ELSE 'its vectors are of the model ' || model || ', searches use {MODEL}' END AS reason FROM codebases",
    "health_counts": f"""WITH {_CODEBASES} SELECT count(*) FILTER (status <> 'deprecated') AS active, count(*) FILTER (status = 'deprecated') AS deprecated, count(*) FILTER (status <> 'deprecated' AND model NOT IN ('', '{MODEL}')) AS mismatch,
  count(*) FILTER (status <> 'deprecated' AND model IN ('', '{MODEL}') AND files % 2 <> 0) AS missing FROM codebases""",
    "resolve_longest_prefix": """WITH p AS (SELECT page_id, string_split_regex(url, '[?#]')[1] AS path FROM pages), s AS (SELECT *, string_split(path, '/') AS x FROM p),
r AS (SELECT array_to_string(x[1:3], '/') AS root FROM s WHERE page_id % 2 = 0 UNION SELECT array_to_string(x[1:4], '/') FROM s WHERE page_id % 3 = 0),
m AS (SELECT page_id, arg_max(root, length(root)) AS root FROM s JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY page_id) SELECT page_id, root FROM p LEFT JOIN m USING (page_id)""",
}
