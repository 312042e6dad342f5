"""DuckDB SQL of the catalogue's queries."""

from __future__ import annotations

from silterra.config import MinHashConfig
from silterra.functions.text import PRIME, WORD

# White space as Unicode has it, which DuckDB's \s hasn't.
_CLEAN = r"trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '[\s\x0B\x{85}\p{Z}]+', ' ', 'g'))"


def build(config: MinHashConfig, chunks: int, rate: float, max_size: int, seed: int, files: int) -> dict[str, str]:
    from silterra.operators.minhash import permutations

    n, ab = config.ngram_size, permutations(config)
    digest = "coalesce(sha256(text), 'null ' || doc_id)"
    groups = f"SELECT doc_id, min(doc_id) OVER (PARTITION BY {digest}) AS cc_id, count(*) OVER (PARTITION BY {digest}) AS cc_size, row_number() OVER (PARTITION BY {digest} ORDER BY doc_id) - 1 AS cc_idx FROM documents"
    numbered = "SELECT doc_id, dense_rank() OVER (ORDER BY source) - 1 AS path_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS line_num FROM documents"
    tokens = f"SELECT doc_id, regexp_extract_all({_CLEAN}, '{WORD}') AS tok FROM documents WHERE text IS NOT NULL"
    shifted = ", ".join(f"tok[{k + 1}:len(tok) - {n - 1 - k}]" for k in range(n))
    joined_gram = " || chr(31) || ".join(f"z[{k + 1}]" for k in range(n))
    grams = f"""WITH RECURSIVE tokens AS ({tokens}),
grams AS (SELECT doc_id, CASE WHEN len(tok) < {n} THEN [array_to_string(tok, chr(31))]
  ELSE list_transform(list_zip({shifted}), lambda z: {joined_gram}) END AS g FROM tokens)"""
    residues = f"""{grams}, residues AS (SELECT DISTINCT doc_id, (('0x' || substr(md5(s), 1, 8))::BIGINT) % {PRIME} AS x FROM (SELECT doc_id, unnest(g) AS s FROM grams))"""
    mins = ", ".join(f"min(({a} * x + {b}) % {PRIME}) AS h{i}" for i, (a, b) in enumerate(ab))
    vectors = f"{residues}, vectors AS (SELECT doc_id, {mins} FROM residues GROUP BY doc_id)"
    rows = config.band_size
    bands = ", ".join("md5(concat_ws(',', " + ", ".join(f"h{k * rows + r}" for r in range(rows)) + "))" for k in range(config.num_bands))
    sigs = f"{vectors}, sigs AS (SELECT doc_id, unnest(range({config.num_bands})) AS band, unnest([{bands}]) AS sig FROM vectors)"
    edges = f"{sigs}, edges AS (SELECT DISTINCT doc_id AS u, v FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY band, sig) AS v FROM sigs) WHERE doc_id <> v)"
    components = f"""{edges}, both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach AS (SELECT u AS doc_id, u AS r FROM both_ways UNION SELECT b.u, a.r FROM reach a JOIN both_ways b ON a.doc_id = b.v),
components AS (SELECT doc_id, min(r) AS cc_id FROM reach GROUP BY doc_id)"""
    annotated = f"""{components}, annotated AS (SELECT d.doc_id, coalesce(c.cc_id, d.doc_id) AS cc_id, CASE WHEN c.cc_id IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY c.cc_id) END AS cc_size,
  CASE WHEN c.cc_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY c.cc_id ORDER BY d.doc_id) - 1 END AS cc_idx FROM documents d LEFT JOIN components c USING (doc_id))"""
    turns = f"SELECT *, conv_id % {files} AS path_id, row_number() OVER (PARTITION BY conv_id % {files} ORDER BY conv_id, turn, role, text) - 1 AS line_num FROM conversations"
    runs = "SELECT *, max(CASE WHEN fresh THEN line_num END) OVER (PARTITION BY path_id ORDER BY line_num) AS group_line FROM (SELECT *, line_num = 0 OR {k} IS DISTINCT FROM lag({k}) OVER (PARTITION BY path_id ORDER BY line_num) AS fresh FROM turns)"
    joined = "SELECT path_id, group_line, coalesce(string_agg(text, chr(10) ORDER BY line_num), '') AS text FROM ({runs}) GROUP BY path_id, group_line"
    metrics = "SELECT coalesce(sum(cc_size), 0)::BIGINT AS docs, count(*) AS groups, (coalesce(sum(cc_size), 0) - count(*))::BIGINT AS removed, round(CASE WHEN count(*) = 0 THEN 0 ELSE (sum(cc_size) - count(*)) / sum(cc_size)::DOUBLE END, 6) AS removal_rate FROM (SELECT cc_id, count(*) AS cc_size FROM {g} GROUP BY cc_id)"
    words = f"SELECT doc_id, len(tok) AS n_tokens, array_to_string(tok, chr(31)) AS tokens FROM (SELECT doc_id, regexp_extract_all({_CLEAN}, '{WORD}') AS tok FROM documents)"
    lines = f"SELECT *, dense_rank() OVER (ORDER BY (doc_id % {files})::VARCHAR) - 1 AS path_id, row_number() OVER (PARTITION BY doc_id % {files} ORDER BY doc_id) - 1 AS line_num FROM documents"
    packed = f"SELECT *, path_id * 4294967296 + line_num AS packed FROM ({lines})"
    of_lines = f"SELECT *, min(packed) OVER (PARTITION BY text) AS cc_id, count(*) OVER (PARTITION BY text) AS cc_size, row_number() OVER (PARTITION BY text ORDER BY packed) - 1 AS cc_idx FROM ({packed})"
    fuzzy_lines = f"""{components}, fuzzy AS (SELECT *, min(packed) OVER (PARTITION BY root) AS cc_id, count(*) OVER (PARTITION BY root) AS cc_size, row_number() OVER (PARTITION BY root ORDER BY packed) - 1 AS cc_idx
  FROM (SELECT p.*, coalesce(c.cc_id, p.doc_id) AS root FROM ({packed}) p LEFT JOIN components c USING (doc_id)))"""
    return {
        "jsonl_scan": "SELECT * FROM documents",
        "jsonl_line_numbers": f"SELECT path_id, line_num, packed, doc_id, md5(text) AS digest FROM ({packed})",
        "command_exact_prune": f"SELECT doc_id, lang FROM ({of_lines}) WHERE cc_idx = 0",
        "command_exact_annotate": f"SELECT doc_id, cc_id, cc_size, cc_idx FROM ({of_lines})",
        "command_min_hash_prune": f"{fuzzy_lines} SELECT doc_id, lang FROM fuzzy WHERE cc_idx = 0",
        "command_min_hash_annotate": f"{fuzzy_lines} SELECT doc_id, cc_id, cc_size, cc_idx FROM fuzzy",
        "command_stages": f"{fuzzy_lines} SELECT packed AS doc_id, cc_id FROM fuzzy WHERE cc_size > 1",
        "command_subsample": f"SELECT doc_id FROM ({of_lines}) WHERE cc_size <= {max_size} AND (('0x' || substr(md5('{seed}:' || cc_id), 1, 8))::BIGINT) % {PRIME} < {rate * PRIME}",
        "scan_documents": "SELECT * FROM documents",
        "path_chunk": f"SELECT doc_id, path_id, path_id % {chunks} AS chunk FROM ({numbered})",
        "path_line_counts": f"SELECT path_id, max(line_num) + 1 AS lines FROM ({numbered}) GROUP BY path_id",
        "docid_pack": f"SELECT doc_id, path_id * 4294967296 + line_num AS packed, path_id, line_num FROM ({numbered})",
        "exact_annotate": groups,
        "exact_groups": f"SELECT doc_id, cc_id, cc_size FROM ({groups}) WHERE cc_size > 1",
        "exact_prune": f"SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({groups}) WHERE cc_idx > 0)",
        "cc_size_index": f"SELECT cc_id, count(*) AS cc_size FROM ({groups}) GROUP BY cc_id",
        "cc_size_histogram": f"SELECT cc_size, count(*) AS n_groups FROM ({groups}) WHERE cc_idx = 0 GROUP BY cc_size",
        "dedup_metrics": metrics.format(g=f"({groups})"),
        "clean_text": f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents",
        "tokenize_words": words,
        "tokenize_uniseg": words,
        "tokenize_bytes": f"SELECT doc_id, octet_length(encode(c)) AS n_tokens, md5(array_to_string(list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT::VARCHAR), ',')) AS tokens FROM (SELECT doc_id, {_CLEAN} AS c, hex(encode({_CLEAN})) AS h FROM documents)",
        "shingles": f"{grams}, kept AS (SELECT doc_id, s, min(i) AS i FROM (SELECT doc_id, unnest(g) AS s, unnest(range(len(g))) AS i FROM grams) GROUP BY doc_id, s) SELECT doc_id, count(*) AS n_shingles, md5(string_agg(s, chr(30) ORDER BY i)) AS digest FROM kept GROUP BY doc_id",
        "minhash_vector": f"{vectors} SELECT doc_id, concat_ws(',', {', '.join(f'h{i}' for i in range(len(ab)))}) AS h FROM vectors",
        "band_signatures": f"{sigs} SELECT * FROM sigs",
        "lsh_groups": f"{edges} SELECT * FROM edges",
        "minhash_exact_mode": f"SELECT doc_id, cc_id FROM ({groups}) WHERE cc_size > 1",
        "connected_components": f"{components} SELECT * FROM components",
        "kill_list": f"{components} SELECT doc_id FROM components WHERE doc_id <> cc_id",
        "fuzzy_prune": f"{components} SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM components WHERE doc_id <> cc_id)",
        "fuzzy_annotate": f"{annotated} SELECT * FROM annotated",
        "fuzzy_metrics": f"{annotated} {metrics.format(g='annotated')}",
        "true_jaccard": f"""{components}, sets AS (SELECT DISTINCT cc_id, doc_id, unnest(g) AS s FROM components JOIN grams USING (doc_id)),
sizes AS (SELECT *, min(doc_id) OVER (PARTITION BY cc_id, h) AS rep FROM (SELECT cc_id, doc_id, count(*) AS n, md5(string_agg(s, chr(30) ORDER BY s)) AS h FROM sets GROUP BY cc_id, doc_id)),
reps AS (SELECT * FROM sizes WHERE doc_id = rep), of_reps AS (SELECT sets.* FROM sets JOIN reps USING (doc_id)),
common AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS n_inter FROM of_reps a JOIN of_reps b ON a.cc_id = b.cc_id AND a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id)
SELECT x.cc_id, x.doc_id AS doc_a, y.doc_id AS doc_b, coalesce(n_inter, 0) AS n_inter, x.n + y.n - coalesce(n_inter, 0) AS n_union, round(coalesce(n_inter, 0) / (x.n + y.n - coalesce(n_inter, 0))::DOUBLE, 6) AS jaccard
FROM reps x JOIN reps y ON x.cc_id = y.cc_id AND x.doc_id < y.doc_id LEFT JOIN common ON doc_a = x.doc_id AND doc_b = y.doc_id
UNION ALL SELECT cc_id, rep, doc_id, n, n, 1.0 FROM sizes WHERE doc_id <> rep""",
        "dup_aware_subsample": f"SELECT doc_id, cc_id FROM ({groups}) WHERE cc_size <= {max_size} AND (('0x' || substr(md5('{seed}:' || cc_id), 1, 8))::BIGINT) % {PRIME} < {rate * PRIME}",
        "concat_group": f"WITH turns AS ({turns}) {joined.format(runs=runs.format(k='conv_id'))}",
        "concat_prune": f"""WITH turns AS ({turns}), grouped AS ({joined.format(runs=runs.format(k='role'))}),
dead AS (SELECT path_id, group_line AS line_num FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY path_id, group_line) AS k FROM grouped) WHERE k > 1),
marked AS (SELECT turns.*, bool_or(dead.line_num IS NOT NULL) OVER (PARTITION BY turns.path_id, conv_id ORDER BY turns.line_num) AS gone FROM turns LEFT JOIN dead ON turns.path_id = dead.path_id AND turns.line_num = dead.line_num)
SELECT path_id, line_num, conv_id, turn FROM marked WHERE NOT gone""",
    }
