"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import conversation_trie, filter_audit, imatch, langid, license_scan, line_dedup, mixing, pieces, quality, simhash, substrings, tokens, warc
from reviewloom.llm.common import WORD, documents
from reviewloom.llm.registry import query

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE_CHARS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, and of no line."""
    return tokens.count_tokens(documents(spark, sf_dir))


@query(license_scan.license_sql())
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences recognised in every document."""
    return license_scan.scan_licenses(documents(spark, sf_dir))


@query()
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdict of every document."""
    found = quality.apply_rules(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "dup_ngram_shares", "dup_line_share", "later_ngram_shares",
    )


@query()
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of the labelled ones."""
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    labelled = docs.filter(F.col("lang").isNotNull() & ~held_out).select("doc_id", "lang")
    found = langid.identify(docs, langid.fit(docs, labelled))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query()
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document and the text decoded from them, as digests."""
    encoded = pieces.encode(documents(spark, sf_dir), with_decoded=True)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, trim({LOWER.format("line")}, {SPACE_CHARS}) AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, f.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of at least ten documents."""
    found = line_dedup.dedupe_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def _imatch_sql() -> str:
    punctuation = imatch.PUNCTUATION.replace("'", "''")
    terms = (
        "list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array("
        + LOWER.format("{0}")
        + f", '[\\x20\\x09-\\x0D]+'), lambda w: trim(w, '{punctuation}')), lambda w: w <> '')))"
    )
    subsets = ", ".join(imatch.subsets_sql("{0}", "('0x' || {0})::INT"))
    code = "('0x' || substr(md5({0}), 1, 12))::BIGINT"

    def near(a: str, b: str) -> str:
        left, right = f"string_split({a}, '.')", f"string_split({b}, '.')"
        same = f"len(list_intersect({left}, {right}))"
        return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE (2.0::DOUBLE * {same}) / (len({left}) + len({right})) END"

    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
looked AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following,
    coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id, length(text) AS n_chars FROM docs),
edited AS (SELECT *, left(text, n_chars - n_chars // 2) || left(following, n_chars // 2) AS edit FROM looked),
texts AS (SELECT doc_id, 0 AS which, {terms.replace("{0}", "text")} AS terms FROM edited
    UNION ALL SELECT doc_id, 1, {terms.replace("{0}", "edit")} FROM edited),
pairs AS (SELECT doc_id, which, unnest(terms) AS term FROM texts),
counted AS (SELECT term, count(*) AS n FROM pairs WHERE which = 0 GROUP BY term),
lexicon AS (SELECT term, {code.format('term')} AS code, [{subsets}] AS subsets FROM counted
    WHERE n >= {imatch.MIN_DOCS} AND n >= {imatch.LOW_SHARE} * (SELECT count(*) FROM docs) AND n <= {imatch.HIGH_SHARE} * (SELECT count(*) FROM docs)),
members AS (SELECT doc_id, which, code, unnest(subsets) AS subset FROM pairs JOIN lexicon USING (term)
    UNION ALL SELECT doc_id, which, {code.format("array_to_string(terms, ' ')")}, {imatch.WHOLE} FROM texts),
held AS (SELECT doc_id, which, subset, count(*) AS n, min(code) AS least, max(code) AS most, sum(code)::BIGINT AS total
    FROM members WHERE subset IS NOT NULL GROUP BY ALL),
tokens AS (SELECT doc_id, which, subset, {imatch.token_sql("printf('%03x', subset)")} AS token FROM held WHERE n <= {imatch.MAX_TERMS}),
prints AS (SELECT doc_id, which, coalesce(string_agg(token, '.' ORDER BY token) FILTER (subset < {imatch.WHOLE}),
    max(token) FILTER (subset = {imatch.WHOLE})) AS print FROM tokens GROUP BY ALL),
joined AS (SELECT e.doc_id, e.n_chars, sha256(e.edit) AS edited_sha256, a.print AS fingerprint, b.print AS edited_fingerprint, c.print AS next_print
    FROM edited e JOIN prints a ON a.doc_id = e.doc_id AND a.which = 0 JOIN prints b ON b.doc_id = e.doc_id AND b.which = 1
    JOIN prints c ON c.doc_id = e.next_id AND c.which = 0)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    {near("fingerprint", "edited_fingerprint")} AS near_edited, {near("fingerprint", "next_print")} AS near_next FROM joined"""


@query(_imatch_sql())
def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return imatch.fingerprint_with_edits(documents(spark, sf_dir))


@query()
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query()
def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    responses = warc.responses_from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.derivatives(responses).select(
        F.col("id").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri", "content_type", "content_length",
        "block_digest", "payload_digest", "source_payload_digest",
    )


@query(f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
told AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
tests AS (SELECT t.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
     regexp_matches(text, '[#$%&*|]'), coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)] AS fails
    FROM texts t LEFT JOIN told USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INTEGER AS step FROM orders),
cells AS (SELECT part, fails, good, toxic, count(*) AS n FROM tests GROUP BY ALL),
judged AS (SELECT part, good, toxic, n, filter_order, step, filter_order[step] AS letter, fails[ascii(filter_order[step]) - 64] AS bad,
    list_bool_or([false] || list_transform(string_split(filter_order[1:step - 1], ''), lambda x: x <> '' AND fails[greatest(ascii(x) - 64, 1)])) AS gone,
    len(list_filter(fails, lambda f: f)) AS n_fails FROM cells, steps),
counted AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN bad AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN bad AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN bad AND NOT gone AND good = 1 THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN bad AND NOT gone AND toxic = 1 THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM judged GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM counted""")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at every step of all 120 orders, by language."""
    failed = filter_audit.failed_filters(documents(spark, sf_dir))
    return filter_audit.audit(failed, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query(f"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS key
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM texts)),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY key ORDER BY doc_id, p) AS r FROM windows),
covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM ranked WHERE r > 1),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts),
kept AS (SELECT words.doc_id, count(covered.i) AS n_removed,
    sha256(coalesce(string_agg(word, ' ' ORDER BY words.i) FILTER (covered.i IS NULL), '')) AS kept_sha256
    FROM words LEFT JOIN covered USING (doc_id, i) GROUP BY words.doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)""")
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of passages that occur earlier."""
    found = substrings.drop_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def _trie_sql() -> str:
    # CRC-32 of the decimal id, bit by bit; the first element is what the fold begins with
    step = "list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))"
    digits = "list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda s, b: {step}), 4294967295)"
    return f"""
WITH turns AS (SELECT conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, list(said ORDER BY pos) AS said, ({crc} % 9)::BIGINT AS h FROM turns GROUP BY conv_id),
built AS (SELECT c.conv_id, list_concat(coalesce(b.said[1:c.h], []), c.said[c.h + 1:]) AS said
    FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 5),
paths AS (SELECT conv_id, said, len(said) AS n, unnest(range(0, len(said) + 1)) AS depth FROM built),
keyed AS (SELECT conv_id, n, depth, sha256(to_json(said[1:depth])::VARCHAR) AS key,
    CASE WHEN depth > 0 THEN sha256(to_json(said[1:depth - 1])::VARCHAR) END AS up, strlen(said[depth].t) AS size FROM paths),
nodes AS (SELECT depth, key, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(size), 0) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM keyed GROUP BY depth, key),
kids AS (SELECT up AS key, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (key, depth)),
-- a node and all below it: those on the path of its smallest members
chains AS (SELECT DISTINCT a.key, a.depth, b.key AS below, b.depth AS below_depth FROM keyed a JOIN keyed b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (SELECT c.key, c.depth, sum((w.n_convs - 1) * w.size)::BIGINT AS saved_tokens, count(*) FILTER (w.n_children = 0) AS n_leaves
    FROM chains c JOIN whole w ON w.key = c.below AND w.depth = c.below_depth GROUP BY ALL)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
FROM whole w JOIN sums s USING (key, depth) LEFT JOIN nodes p ON p.key = w.up AND p.depth = w.depth - 1"""


@query(_trie_sql())
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    convs, turns = conversation_trie.rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_trie.conversation_trie(convs, turns)


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline`` one after another."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
