"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm import byte_bpe, fingerprints, html_layout, langid, neardup, orc_tokens, packing, periodic, quality, ranked, secrets, topk, tree_bpe
from corpuslake.session import cut, scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every text and of its edited text, with likenesses."""
    rows = fingerprints.with_next_text(_table(spark, sf_dir, "documents"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    for column, prefix in (("text", "a_"), ("edited", "b_"), ("next_text", "c_")):
        rows = fingerprints.with_tree(rows, column, prefix)
    rows = fingerprints.differing_branches(rows, "a_", "b_")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("a_root").alias("fingerprint"),
        F.col("b_root").alias("edited_fingerprint"),
        fingerprints.likeness("a_pieces", "b_pieces").alias("near_edited"),
        fingerprints.likeness("a_pieces", "c_pieces").alias("near_next"),
        F.concat_ws(",", F.col("sections_edited").cast("array<string>")).alias("sections_edited"),
        F.size("paragraphs_edited").cast("long").alias("paragraphs_edited"),
    )


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every text, with what the ownership counts add."""
    rows = secrets.scan(_table(spark, sf_dir, "documents"))
    n = lambda where, kind: F.expr(f"cast(size(filter({where}, x -> x.kind = '{kind}')) as bigint)")
    return rows.select(
        "doc_id",
        *[n("base", kind).alias(f"n_{kind}") for kind, *_ in secrets.PATTERNS],
        F.expr(f"sha2({secrets.joined('base')}, 256)").alias("base_sha256"),
        F.expr(secrets.joined("array_sort(concat(base, added))")).alias("spans"),
        *[n("added", kind).alias(f"n_{kind}") for kind in secrets.ADDED],
    )


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners of each query vector."""
    rows = cut(topk.usable(_table(spark, sf_dir, "embeddings")))
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"), 10)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every text, learned from the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(spark, docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return html_layout.extract(_table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text, learned from labels that are not held out."""
    described = cut(quality.describe(_table(spark, sf_dir, "documents")))
    model = quality.fit(described, _table(spark, sf_dir, "labels").where(~langid.held_out()))
    return quality.score(spark, described, model).select("doc_id", langid.held_out().alias("held_out"), "score", "predicted")


def packed_pieces(docs: DataFrame) -> DataFrame:
    """Pieces of all documents with their digests and places in sequences."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"))
    return packing.pack(digests)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packed_pieces(_table(spark, sf_dir, "documents"))


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to ORC files and read back."""
    path = scratch(spark, "token-orc")
    orc_tokens.write_token_orc(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), spaced=True, end_id=2)
    back = orc_tokens.read_token_orc(spark, path)
    return orc_tokens.ids_crc32(back.select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), "ids"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of every text and the bytes that they decode to."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = byte_bpe.round_trip(_table(spark, sf_dir, "documents"), ranks, pattern)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by tree concatenation and the text that they decode to."""
    rows = tree_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_WORD = r"[^\x20\x09-\x0D]+"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; where h % 10 = 0 the words from number a on repeat the first p of them (h, a and p as op12 fixes them)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.crc32(F.col("doc_id").cast("string")).alias("h"))
    words = rows.where("h % 10 = 0").withColumn("w", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).where("size(w) > 0")
    words = words.withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("cast(g % n as int)"))
    words = words.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    edited = F.expr("array_join(transform(sequence(0, n - 1), i -> w[if(i < a, i, a + (i - a) % p)]), ' ')")
    same = rows.where(f"h is null or h % 10 <> 0 or text is null or not text rlike '{_WORD}'")
    return same.select("doc_id", "text").unionByName(words.select("doc_id", edited.alias("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of repeated words of every text, the longest one, and what is left without the repeats."""
    rows = periodic.find_runs(with_planted_runs(_table(spark, sf_dir, "documents")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    rows = rows.withColumn("best", F.when(F.size("runs") > 0, best))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.expr("sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), ''), 256)").alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item, from an index of all documents."""
    path = scratch(spark, "ranked-index")
    ranked.build(_table(spark, sf_dir, "documents"), path)
    return ranked.search(spark, path, _table(spark, sf_dir, "benchmark"), 10)


QUERIES = {
    f.__name__: f
    for f in (
        *(op1_fingerprints, op2_near_duplicates, op3_secret_scan, op4_top_k, op5_language_id, op6_html_layout, op7_quality, op8_best_fit_packing, op9_token_orc, op10_byte_bpe),
        *(op11_tree_bpe, op12_periodic_runs, op13_ranked_search),
    )
}


#: Fixed values, stated here again for the SQL: the pieces of a paragraph, and each kind of secret with the group and least length of its value.
_PIECES = r"(?:\S*[^\s.!?]\s+){0,11}\S+\s*|\s+"
_KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)


def _tree_sql(src: str, text: str, p: str) -> str:
    """CTEs {p}1 to {p}4: hashes of pieces, paragraphs, sections and root of ``text`` in ``src``, by doc_id."""
    return rf"""
    {p}0 AS (SELECT doc_id, string_split({text}, chr(10)) AS ls FROM {src}),
    {p}1 AS (SELECT doc_id, [[sha256(x) FOR x IN regexp_extract_all(CASE WHEN i < len(ls) THEN ls[i] || chr(10) ELSE ls[i] END, '{_PIECES}')] FOR i IN range(1, len(ls) + 1)] AS h FROM {p}0),
    {p}2 AS (SELECT doc_id, h, flatten(h) AS pieces, [sha256('p' || array_to_string(x, '')) FOR x IN h] AS pars FROM {p}1),
    {p}3 AS (SELECT doc_id, pieces, pars, [i FOR i IN range(1, len(pars) + 1) IF i = len(pars) OR pars[i] < '2' OR h[i] = [sha256(chr(10))]] AS ends FROM {p}2),
    {p}4 AS (SELECT doc_id, pieces, pars, ends, [sha256('s' || array_to_string(pars[CASE WHEN k = 1 THEN 1 ELSE ends[k - 1] + 1 END:ends[k]], '')) FOR k IN range(1, len(ends) + 1)] AS secs, sha256('r' || array_to_string([sha256('s' || array_to_string(pars[CASE WHEN k = 1 THEN 1 ELSE ends[k - 1] + 1 END:ends[k]], '')) FOR k IN range(1, len(ends) + 1)], '')) AS root FROM {p}3)"""


#: From the root down: sections that the edited text lacks, then the paragraphs within those.
_SECTIONS_SQL = "CASE WHEN a4.root = b4.root THEN [] ELSE [k FOR k IN range(1, len(a4.secs) + 1) IF NOT list_contains(b4.secs, a4.secs[k])] END"
_PARAGRAPHS_SQL = f"len([i FOR i IN flatten([range(CASE WHEN k = 1 THEN 1 ELSE a4.ends[k - 1] + 1 END, a4.ends[k] + 1) FOR k IN {_SECTIONS_SQL}]) IF NOT list_contains(b4.pars, a4.pars[i])])"


def _like_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE len(list_distinct(list_intersect({a}, {b}))) / len(list_distinct({a} || {b})) END"


def _spans_sql(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    rx = pattern.replace("'", "''")
    return f"""SELECT doc_id, source, '{kind}' AS kind, {number} AS k, unnest(range(1, len(m) + 1)) AS i, gaps, m, v, {least} AS least
        FROM (SELECT doc_id, source, string_split_regex(text, '{rx}') AS gaps, regexp_extract_all(text, '{rx}') AS m, regexp_extract_all(text, '{rx}', {group}) AS v FROM d)"""


_LOOKS = r"regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, '(?i)example|sample|dummy|changeme|placeholder|your[-_]?|xxxx|0000000|1234567|abcdef0') AND NOT repeated AND length(v) >= 12"

ORACLE_SQL = {
    "op1_fingerprints": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS nxt FROM d),
        e AS (SELECT doc_id, text, nxt, substring(text, 1, length(text) - length(text) // 2) || substring(nxt, 1, length(text) // 2) AS edited FROM n),
        {_tree_sql('e', 'text', 'a')}, {_tree_sql('e', 'edited', 'b')}, {_tree_sql('e', 'nxt', 'c')}
        SELECT e.doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, a4.root AS fingerprint, b4.root AS edited_fingerprint,
            {_like_sql('a4.pieces', 'b4.pieces')} AS near_edited, {_like_sql('a4.pieces', 'c4.pieces')} AS near_next,
            array_to_string([k - 1 FOR k IN {_SECTIONS_SQL}], ',') AS sections_edited, CAST({_PARAGRAPHS_SQL} AS BIGINT) AS paragraphs_edited
        FROM e JOIN a4 USING (doc_id) JOIN b4 USING (doc_id) JOIN c4 USING (doc_id)""",
    "op2_near_duplicates": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
        u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
        e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        r(id, seen) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen),
        c AS (SELECT id AS doc_id, min(seen) AS component_id FROM r GROUP BY id)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)""",
    "op3_secret_scan": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents),
        m AS ({' UNION ALL '.join(_spans_sql(kind, k, rx, group, least) for k, (kind, rx, group, least) in enumerate(_KINDS))}),
        f AS (SELECT doc_id, source, kind, k, v[i] AS v, CAST(list_sum([length(gaps[j]) FOR j IN range(1, i + 1)]) + coalesce(list_sum([length(m[j]) FOR j IN range(1, i)]), 0) AS BIGINT) AS s, length(m[i]) AS n
            FROM m WHERE length(v[i]) >= least),
        b AS (SELECT doc_id, source, kind, k, v, s, s + n AS e FROM f),
        o AS (SELECT v, count(DISTINCT split_part(source, '/', 1)) AS owners, len([c FOR c IN range(1, length(v)) IF length(v) - c >= 7 AND v[c:c + 7] = repeat(v[c:c], 8)]) > 0 AS repeated FROM b GROUP BY v),
        g AS (SELECT v, CASE WHEN owners >= 3 THEN 'copied' WHEN owners = 1 AND {_LOOKS} THEN 'live' END AS kind FROM o),
        a AS (SELECT DISTINCT doc_id, g.kind, CASE g.kind WHEN 'live' THEN 3 ELSE 4 END AS k, b.e - length(b.v) AS s, b.e, b.v FROM b JOIN g USING (v) WHERE g.kind IS NOT NULL),
        x AS (SELECT doc_id, kind, k, s, e, true AS base FROM b UNION ALL SELECT doc_id, kind, k, s, e, false FROM a),
        j AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (WHERE base), '') AS base,
            count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, count(*) FILTER (WHERE k = 3) AS n_live, count(*) FILTER (WHERE k = 4) AS n_copied FROM x GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
        FROM d LEFT JOIN j USING (doc_id)""",
    "op4_top_k": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)]) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op13_ranked_search": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, ts FROM d WHERE len(ts) > 0),
        g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM l),
        p AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM l) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, g GROUP BY term),
        q AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
        s AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), g GROUP BY item_id, doc_id),
        r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
}
