"""The queries of this folder's operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import PATTERN, path

from . import bpe, decontaminate, divergence, kneser_ney, licenses, linededup, merkle, quality, quotes, sharding, simhash, tokencount, warc

RANKS = path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.attribute_tokens(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_held_out(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_conversations(table(spark, sf_dir, "conversations"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_rules(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.without_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_sharding, op3_lm_scoring, op4_chat_formatting, op5_byte_bpe, op6_simhash, op7_decontamination, op8_quality_rules, op9_license_scan, op10_warc, op11_source_divergence, op12_merkle_manifest, op13_line_dedup)}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(regexp_replace(translate({text}, '{licenses._UPPER}', '{licenses._LOWER}'), '(?m){licenses.COPYRIGHT_LINE}', '', 'g'), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g')"
    out = f"(' ' || {out} || ' ')"
    for a, b in licenses.EQUIVALENT.items():
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'), ' ')"


def license_sql() -> str:
    known, stated = (", ".join(f"({_quote(d)}, {_quote(n)})" for d, n in sorted(x.items())) for x in (licenses.known_digests(), licenses.stated_digests()))
    return f"""
WITH known(digest, license) AS (VALUES {known}),
docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
whole AS (SELECT r, doc_id, sha256({_canonical_sql('text')}) AS digest FROM docs),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
stated(digest, license) AS (VALUES {stated}),
hits AS (SELECT r, k.license FROM lines JOIN stated k ON k.digest = sha256({_canonical_sql('line')})),
notices AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n FROM hits GROUP BY r)
SELECT w.doc_id, w.digest, k.license, n.notices, coalesce(n.n, 0)::BIGINT AS n_notice_lines
FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN notices n USING (r)"""


def warc_sql() -> str:
    """Base32 from the hex digest: its 160 bits are 32 groups of five."""
    bits = "list_aggregate(list_transform(string_split(hex, ''), lambda x: lpad(bin(strpos('0123456789abcdef', x) - 1), 4, '0')), 'string_agg', '')"
    places = " + ".join(f"(bits[5 * i + {j + 1}])::INT * {16 >> j}" for j in range(5))
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, {bits} AS bits, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + {places}]), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""


def _cover_sql(n: int) -> str:
    gram = " || chr(9) || ".join(f"lead(w, {k}) OVER doc" if k else "w" for k in range(n))
    return f"""g{n} AS (SELECT r, i, w, {gram} AS g FROM word WINDOW doc AS (PARTITION BY r ORDER BY i)),
d{n} AS (SELECT r, i, g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 AS dup, w FROM g{n}),
c{n} AS (SELECT r, w, max(dup::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS hit FROM d{n}),
s{n} AS (SELECT r, sum(hit) AS words, sum(hit * length(w)) AS chars FROM c{n} GROUP BY r)"""


def quality_sql() -> str:
    q = quality
    covers = ",\n".join(_cover_sql(n) for n in q.NGRAM_LIMITS)
    share = lambda n: f"coalesce(s{n}.chars, 0) / greatest(b.word_chars, 1)::DOUBLE"
    bad = " OR ".join(f"{share(n)} > {limit}" for n, limit in q.NGRAM_LIMITS.items())
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
word AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM docs)),
line AS (SELECT r, l, row_number() OVER (PARTITION BY r, l) AS k, length(regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars
    FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
lines AS (SELECT r, count(*) AS n, count(*) FILTER (k > 1) AS dup, coalesce(sum(chars) FILTER (k > 1), 0) AS chars FROM line GROUP BY r),
b AS (SELECT r, doc_id, text, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_words,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM docs),
{covers},
m AS (SELECT b.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, coalesce(lines.dup, 0)::BIGINT AS n_dup_lines,
    coalesce(s{q.BASE_WINDOW}.words, 0)::BIGINT AS n_repeat_words, coalesce(lines.chars, 0)::BIGINT AS dup_line_chars,
    {', '.join(f'{share(n)} AS cover_{n}' for n in q.NGRAM_LIMITS)},
    coalesce(lines.dup > {q.LINE_LIMIT} * lines.n, false) OR coalesce(lines.chars, 0) > {q.LINE_CHAR_LIMIT} * word_chars OR {bad} AS bad
    FROM b LEFT JOIN lines USING (r) {' '.join(f'LEFT JOIN s{n} USING (r)' for n in q.NGRAM_LIMITS)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, {', '.join(f'cover_{n}' for n in q.NGRAM_LIMITS)},
    n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.BASE_PERCENT} * n_words AS base_failed,
    NOT (bad OR n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.BASE_PERCENT} * n_words) AS kept FROM m"""


def divergence_sql() -> str:
    """In integers of 128 bits."""
    d = divergence
    p = f"1 + ({d.SCALE}::HUGEINT * (coalesce({{n}}, 0) + {d.SMOOTH})) // ({{total}} + {d.SMOOTH} * v)"
    apart = "((p - q) * (p - q)) // q"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {d.MIN_DOCS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, coalesce(v, 0) AS v, coalesce(n, 0) AS total FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang) USING (lang)),
groups AS (SELECT lang, source, v, coalesce(n, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL) USING (lang, source)),
own AS (SELECT g.lang, g.source, k.term, c.n, {p.format(n='c.n', total='g.total')} AS p FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
base AS (SELECT k.lang, k.term, {p.format(n='k.n', total='l.total')} AS q FROM kept k JOIN langs l USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, a.v FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum({apart}) AS value FROM own a JOIN (SELECT lang, source, term, p AS q FROM own) b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
    UNION ALL SELECT lang, source, 'term', term, {apart} FROM own JOIN base USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {d.TOP}"""


#: CRC-32, bit by bit: a character is mixed in, then eight steps follow.
_CRC_SQL = "xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda h, e: CASE WHEN e >= 0 THEN xor(h, e) ELSE xor(h >> 1, 3988292384 * (h & 1)) END))"


def _tree_sql(name: str, nodes: str, fanout: int) -> str:
    """All nodes of trees, level by level: (tree, idx, own, lvl, n), n the number of nodes of the tree on the level."""
    return f"""{name} AS (SELECT tree, idx, own, 0 AS lvl, count(*) OVER (PARTITION BY tree) AS n FROM {nodes}
    UNION ALL SELECT tree, idx // {fanout}, sha256(string_agg(own, '' ORDER BY idx)), lvl + 1, (any_value(n) + {fanout - 1}) // {fanout} FROM {name} WHERE n > 1 GROUP BY tree, idx // {fanout}, lvl)"""


def merkle_sql(fanout: int = merkle.FANOUT) -> str:
    field = lambda x: f"coalesce(octet_length(encode({x}::VARCHAR)) || ':' || {x}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if n == "text" else n) for n in merkle.FIELDS) + ")"
    def sides(walks: str, nodes: str) -> str:
        """The neighbours, left and right, of each row's node on each level below ``depth``; steps are counted from ``first``."""
        walk = f"SELECT r, tree, lvl, first + lvl AS step, idx // ({fanout} ** lvl)::BIGINT AS spot FROM {walks}, (SELECT DISTINCT lvl FROM {nodes}) WHERE lvl < depth"
        side = lambda op: f"coalesce(string_agg(t.own, '' ORDER BY t.idx) FILTER (t.idx {op} w.spot), '')"
        return f"SELECT r, step, {side('<')} AS l, {side('>')} AS r_ FROM ({walk}) w JOIN {nodes} t ON t.tree = w.tree AND t.lvl = w.lvl AND t.idx // {fanout} = w.spot // {fanout} GROUP BY r, step"

    return f"""
WITH RECURSIVE docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS tree, {leaf('text')} AS own,
    CASE WHEN doc_id IS NOT NULL AND {_CRC_SQL} % {merkle.TAMPERED} = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, own, r) - 1 AS idx FROM docs),
{_tree_sql('lower_', 'leaves', fanout)},
subs AS MATERIALIZED (SELECT tree AS source, own, lvl AS depth, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, '' AS tree FROM lower_ WHERE n = 1),
{_tree_sql('upper_', 'subs', fanout)},
root AS MATERIALIZED (SELECT own AS root, lvl AS height FROM upper_ WHERE n = 1),
below AS MATERIALIZED (SELECT e.r, e.tree, e.idx, s.depth, 0 AS first FROM leaves e JOIN subs s ON s.source = e.tree),
above AS MATERIALIZED (SELECT e.r, '' AS tree, s.idx, height AS depth, s.depth AS first FROM leaves e JOIN subs s ON s.source = e.tree, root),
sides AS MATERIALIZED ({sides('below', 'lower_')} UNION ALL {sides('above', 'upper_')}),
proofs AS (SELECT r, sha256(string_agg(l || r_, '' ORDER BY step)) AS proof FROM sides GROUP BY r),
folds AS (SELECT r, 0 AS step, coalesce(changed, own) AS h FROM docs UNION ALL SELECT f.r, f.step + 1, sha256(s.l || f.h || s.r_) FROM folds f JOIN sides s ON s.r = f.r AND s.step = f.step),
folded AS (SELECT r, max_by(h, step) AS h FROM folds GROUP BY r)
SELECT doc_id, d.own AS leaf, s.own AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, h AS folded_root, h = root AS verified
FROM docs d JOIN subs s ON s.source = d.tree JOIN folded USING (r) LEFT JOIN proofs USING (r), root"""


def lines_sql() -> str:
    blank = "[\\x20\\x09-\\x0D]+"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {(1 << 63) - 1}) AS d, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT r, d, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM docs),
keyed AS (SELECT *, translate(regexp_replace(line, '^{blank}|{blank}$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
held AS (SELECT key, min(d) AS first FROM keyed WHERE length(key) >= {linededup.MIN_CHARS} GROUP BY key HAVING count(DISTINCT d) >= {linededup.MIN_DOCS}),
told AS (SELECT r, place, line, coalesce(d <> first, false) AS gone FROM keyed LEFT JOIN held USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM told JOIN docs USING (r) GROUP BY r"""


def oracle_sql() -> dict[str, str]:
    """The others can't be put in DuckDB's SQL (check sums, merges, fingerprints, singular vectors); the tests hold them
    against brute force."""
    return {"op8_quality_rules": quality_sql(), "op9_license_scan": license_sql(), "op10_warc": warc_sql(), "op11_source_divergence": divergence_sql(), "op12_merkle_manifest": merkle_sql(), "op13_line_dedup": lines_sql()}
