"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit."""
    bit = "lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), {bit})"
    return f"xor(list_reduce(list_concat([4294967295]::BIGINT[], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), {byte}), 4294967295)"


def _leaf(*values: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({v})::VARCHAR) || ':' || ({v})::VARCHAR, '-')" for v in values) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _steps(nodes: str) -> str:
    """Each node with its run's others, joined left and right of it; none at the top."""
    run = "PARTITION BY tree, lvl, place // 8 ORDER BY place"
    return f"""SELECT tree, lvl, place, n, coalesce(string_agg(digest, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
      coalesce(string_agg(digest, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {nodes} WHERE n > 1"""


MERKLE = f"""WITH RECURSIVE d AS (
    SELECT row_number() OVER (ORDER BY doc_id) AS row, doc_id, coalesce('=' || lang, '') AS tree, {_leaf("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
      CASE WHEN {crc32("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf("doc_id", "source", "lang", "n_chars", _LOWER)} END AS tampered FROM documents),
  placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM d),
  low AS (SELECT tree, 0 AS lvl, place, leaf AS digest, n FROM placed
    UNION ALL SELECT tree, lvl + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (n + 7) // 8 FROM low WHERE n > 1 GROUP BY tree, lvl, place // 8, n),
  tops AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
  high AS (SELECT '' AS tree, 0 AS lvl, place, digest, n FROM tops
    UNION ALL SELECT tree, lvl + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (n + 7) // 8 FROM high WHERE n > 1 GROUP BY tree, lvl, place // 8, n),
  ls AS ({_steps("low")}), hs AS ({_steps("high")}),
  f AS (SELECT row, tree, 0 AS lvl, place, coalesce(tampered, leaf) AS acc, '' AS sibs FROM placed
    UNION ALL SELECT row, tree, lvl + 1, place // 8, sha256(before || acc || after), sibs || before || after FROM f JOIN ls USING (tree, lvl, place)),
  f2 AS (SELECT row, '' AS tree, 0 AS lvl, tops.place, arg_max(acc, lvl) AS acc, arg_max(sibs, lvl) AS sibs FROM f JOIN tops USING (tree) GROUP BY row, tops.place
    UNION ALL SELECT row, tree, lvl + 1, place // 8, sha256(before || acc || after), sibs || before || after FROM f2 JOIN hs USING (tree, lvl, place)),
  g AS (SELECT row, arg_max(acc, lvl) AS folded_root, sha256(arg_max(sibs, lvl)) AS proof_sha256 FROM f2 GROUP BY row)
  SELECT doc_id, leaf, tops.digest AS subroot, r.digest AS root, proof_sha256, folded_root, folded_root = r.digest AS verified
  FROM placed JOIN g USING (row) JOIN tops USING (tree), (SELECT digest FROM high WHERE n = 1) r"""

TRIE = f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
  ids AS (SELECT c, c - c % 20 AS b, {crc32("c::VARCHAR")} % 4 AS h FROM t GROUP BY 1),
  re AS (SELECT i.c, t.r, t.x, t.p AS d FROM ids i JOIN t ON t.c = i.b WHERE t.p <= i.h
    UNION ALL SELECT i.c, t.r, t.x, least(i.h, coalesce(k.n, 0)) + t.p - i.h FROM ids i JOIN t USING (c) LEFT JOIN (SELECT c, count(*) AS n FROM t GROUP BY 1) k ON k.c = i.b WHERE t.p > i.h),
  m AS (SELECT c, 0 AS d, '' AS k, 0 AS w FROM ids
    UNION ALL SELECT c, d, string_agg(md5(length(r) || ':' || r || x), '') OVER (PARTITION BY c ORDER BY d), len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) FROM re),
  l AS (SELECT c, max(d) AS d FROM m GROUP BY 1),
  n AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS save, left(k, greatest(32 * (d - 1), 0)) AS pk FROM m GROUP BY k, d),
  ch AS (SELECT pk, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
  e AS (SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ends FROM m JOIN l USING (c, d) GROUP BY 1),
  s AS (SELECT a.k, count(*) FILTER (ch.pk IS NULL) AS n_leaves, sum(z.save)::BIGINT AS saved_tokens FROM n a JOIN n z ON starts_with(z.k, a.k) LEFT JOIN ch ON ch.pk = z.k GROUP BY 1)
  SELECT n.conv_id, n.d AS depth, CASE WHEN n.d > 0 THEN p.conv_id END AS parent_conv_id, n.n_convs, coalesce(ch.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
  FROM n JOIN n p ON p.k = n.pk JOIN s ON s.k = n.k LEFT JOIN ch ON ch.pk = n.k LEFT JOIN e ON e.k = n.k"""

ORACLE: dict[str, str] = {"op11_merkle": MERKLE, "op13_trie": TRIE}
