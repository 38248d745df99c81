"""DuckDB SQL of the queries that SQL can express, written by rules where they repeat themselves (levels, rounds)."""

from __future__ import annotations

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _climb(name: str, nodes: str, walkers: str, levels: int) -> list[str]:
    """CTEs that hash runs of eight up to one node per group.

    ``nodes`` has g, i, h; ``walkers`` g, i and the running proof, fold and further columns. Leaves ``<name>_top`` (g, h) and
    ``<name>_out`` (walkers after the last level).
    """
    out = [f"{name}_n0 AS MATERIALIZED (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM {nodes})"]
    walk = walkers
    run = "PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN"
    for k in range(levels):
        at = f"{name}_n{k}"
        out += [
            f"""{name}_s{k} AS (SELECT g, i, n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
                coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {at})""",
            f"""{name}_w{k} AS MATERIALIZED (SELECT w.* REPLACE (CASE WHEN n > 1 THEN w.i // 8 ELSE w.i END AS i,
                CASE WHEN n > 1 THEN proof || a || b ELSE proof END AS proof,
                CASE WHEN n > 1 THEN sha256(a || fold || b) ELSE fold END AS fold) FROM {walk} w JOIN {name}_s{k} s ON w.g = s.g AND w.i = s.i)""",
            f"""{name}_n{k + 1} AS MATERIALIZED (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, i // 8 AS i,
                CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h FROM {at} GROUP BY g, i // 8))""",
        ]
        walk = f"{name}_w{k}"
    return [*out, f"{name}_top AS (SELECT g, h FROM {name}_n{levels})", f"{name}_out AS (SELECT * FROM {walk})"]


def merkle(levels: int = 8) -> str:
    """Query of the Merkle manifest; ``levels`` of eight suffice for 8 ** levels rows of a language and as many languages."""
    def item(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join([item("doc_id"), item("source"), item("lang"), item("n_chars"), item(text)]) + ")"

    bits = "list_reduce([xor(acc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))"
    codes = "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda acc, x: {bits}), 4294967295)"
    changed = leaf(f"translate(text, '{LOWER[0]}', '{LOWER[1]}')")
    return ",\n".join([
        f"WITH h AS MATERIALIZED (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {changed} END AS alt FROM documents)",
        """leaves AS MATERIALIZED (SELECT doc_id, leaf, alt, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
            row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM h)""",
        "own AS (SELECT g, i, leaf AS h FROM leaves)",
        "start AS (SELECT g, i, doc_id, leaf, '' AS proof, coalesce(alt, leaf) AS fold FROM leaves)",
        *_climb("t", "own", "start", levels),
        "groups AS (SELECT 0 AS g, g AS i, h FROM t_top)",
        "upper AS (SELECT 0 AS g, o.g AS i, doc_id, leaf, p.h AS subroot, proof, fold FROM t_out o JOIN t_top p ON o.g = p.g)",
        *_climb("r", "groups", "upper", levels),
    ]) + """
        SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified
        FROM r_out JOIN r_top USING (g)"""


def lloyd(dim: int = 64, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024) -> str:
    """Query of the exact k-means: one pair of CTEs per round."""
    ctes = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS w
            FROM embeddings WHERE len(embedding) = {dim} AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e))))""",
        "x AS MATERIALIZED (SELECT r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM v)",
        f"""seeds AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR) NULLS LAST, w) - 1 AS c, w FROM v
            QUALIFY c < {k})""",
        "c0 AS MATERIALIZED (SELECT c, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS m FROM seeds)",
    ]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT r, min({{'d': d, 'c': c}}) AS best FROM (SELECT r, c, sum((x - m) * (x - m))::BIGINT AS d
            FROM x JOIN c{i} USING (j) GROUP BY r, c) GROUP BY r)""")
        if i < rounds:
            ctes.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, j, coalesce((s - ((s % n) + n) % n) // n, m) AS m FROM c{i} LEFT JOIN
                (SELECT best.c AS c, j, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{i} USING (r) GROUP BY ALL) USING (c, j))""")
    ctes.append(f"ends AS (SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY j)) AS digest FROM c{rounds} GROUP BY c)")
    return "WITH " + ",\n".join(ctes) + f"""
        SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
               (sum(best.d) OVER ())::BIGINT AS inertia, digest AS centroid_sha256
        FROM a{rounds} JOIN v USING (r) JOIN ends ON ends.c = best.c"""
