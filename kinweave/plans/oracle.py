"""DuckDB SQL for the named queries: one chain of common tables, and what each query selects from it."""

from __future__ import annotations

from ..config import Config

K = Config()


def _tokens(field: str) -> str:
    return f"SELECT DISTINCT country, id, src, unnest(string_split({field}, ' ')) AS token FROM r"


def _cosine(post: str, k: int, answer: str) -> str:
    return f"""SELECT country, q, c, score FROM (SELECT *, row_number() OVER (PARTITION BY country, q ORDER BY score DESC, c) AS rn FROM (
      SELECT a.country, a.id AS q, b.id AS c, round(sum(a.w * b.w), 6) AS score FROM {post} a JOIN {post} b ON a.country = b.country AND a.token = b.token
      WHERE a.src = 1 AND b.src {answer} 1 AND a.id <> b.id GROUP BY 1, 2, 3)) WHERE rn <= {k}"""


def _post(tok: str, idf: str) -> str:
    return f"SELECT country, id, src, token, idf / sqrt(sum(idf * idf) OVER (PARTITION BY country, id)) AS w FROM {tok} JOIN {idf} USING (country, token)"


def _channel(keys: str, cap: int, agg: str) -> str:
    return f"""SELECT a.country, a.id AS q, b.id AS c, {agg} AS score FROM {keys} a JOIN {keys} b ON a.country = b.country AND a.key = b.key
      JOIN (SELECT country, key FROM {keys} WHERE src <> 1 GROUP BY ALL HAVING count(*) <= {cap}) o ON a.country = o.country AND a.key = o.key
      WHERE a.src = 1 AND b.src <> 1 GROUP BY 1, 2, 3"""


def _pairs(ranked: str) -> str:
    return f"SELECT a.country, a.id, a.src, a.token || '|' || b.token AS key FROM {ranked} a JOIN {ranked} b ON a.country = b.country AND a.id = b.id AND a.token < b.token WHERE a.rn <= {K.rarest} AND b.rn <= {K.rarest}"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0::DOUBLE END"


def jac(f: str) -> str:
    i = f"len(list_intersect(x{f}, y{f}))"
    return ratio(i, f"len(x{f}) + len(y{f}) - {i}")


def cont(f: str) -> str:
    return ratio(f"len(list_intersect(x{f}, y{f}))", f"least(len(x{f}), len(y{f}))")


CHANNELS = {"c2_name": "c2", "c6_addr": "c6", "c1_canon": "c1", "c5_postal": "c5", "c3_pair": "c3", "c4_addr_pair": "c4"}
_B = "coalesce(sum(p) OVER (PARTITION BY country, q ORDER BY p DESC, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)"
FF = "(1.25::DOUBLE / (0.25::DOUBLE * 3.666::DOUBLE + 1.0::DOUBLE))"


def accept(scored: str, pz: str, recall: float = 1.0, bar: str = "1.0::DOUBLE", where: str = "") -> str:
    """choose_k over (country, q, c, p) and (country, q, p_zero)."""
    return f"""SELECT country, q, c, p FROM (SELECT *, max(CASE WHEN k > 0 AND p <= {bar} * bar THEN 1 ELSE 0 END) OVER (PARTITION BY country, q ORDER BY k) AS stopped FROM (
      SELECT *, 0.8::DOUBLE * (1.25::DOUBLE * b / (0.25::DOUBLE * n + k)) AS bar FROM (
        SELECT s.*, row_number() OVER (PARTITION BY country, q ORDER BY p DESC, c) - 1 AS k, {_B} AS b, max(p) OVER (PARTITION BY country, q) AS first,
          greatest(sum(p) OVER (PARTITION BY country, q) / {max(recall, 1e-6)}::DOUBLE, 1e-9::DOUBLE) AS n FROM {scored} s)) JOIN {pz} USING (country, q)) WHERE stopped = 0 AND first * {FF} > p_zero {where}"""


TABLES = {
    "raw": "SELECT p_type AS country, 'S' || CAST(1 + p_partkey % 3 AS VARCHAR) || '-' || CAST(p_partkey AS VARCHAR) AS id, CAST(1 + p_partkey % 3 AS INTEGER) AS src, p_partkey AS k, p_name || ' ' || lower(p_type) AS raw_name, "
    "CAST(p_size AS VARCHAR) || ' ' || replace(lower(p_brand), '#', ' ') || ' ' || CAST(10000 + p_partkey % 97 AS VARCHAR) AS raw_addr FROM part",
    "r": "SELECT *, trim(regexp_replace(lower(raw_name), '[^0-9a-z]+', ' ', 'g')) AS name, trim(regexp_replace(lower(raw_addr), '[^0-9a-z]+', ' ', 'g')) AS addr FROM raw",
    "ent": "SELECT country, id AS q FROM r WHERE src = 1",
    "nt": f"SELECT * FROM ({_tokens('name')}) WHERE token <> ''",
    "atk": f"SELECT * FROM ({_tokens('addr')}) WHERE token <> ''",
    "ndf": "SELECT country, token, count(*) AS df FROM nt WHERE src <> 1 GROUP BY ALL",
    "adf": "SELECT country, token, count(*) AS df FROM atk WHERE src <> 1 GROUP BY ALL",
    "cn": "SELECT country, count(*) AS n FROM r WHERE src <> 1 GROUP BY ALL",
    "nidf": f"SELECT country, token, df, ln(n::DOUBLE / df) AS idf FROM ndf JOIN cn USING (country) WHERE df <= {K.name_df_cap} AND df < n",
    "aidf": f"SELECT country, token, df, ln(n::DOUBLE / df) AS idf FROM adf JOIN cn USING (country) WHERE df <= {K.addr_df_cap} AND df < n",
    "npost": _post("nt", "nidf"),
    "apost": _post("atk", "aidf"),
    "c2": _cosine("npost", K.name_top_k, "<>"),
    "c6": _cosine("apost", K.addr_top_k, "<>"),
    "c1k": "SELECT country, id, src, array_to_string(list_sort(list_distinct(string_split(name, ' '))), ' ') AS key FROM r WHERE name <> ''",
    "c1": _channel("c1k", K.canonical_cap, "1.0::DOUBLE"),
    "ad": "SELECT country, id, src, unnest(string_split(addr, ' ')) AS t FROM r",
    "c5k": "SELECT a.country, a.id, a.src, a.t || '|' || b.t AS key FROM ad a JOIN ad b ON a.country = b.country AND a.id = b.id WHERE regexp_matches(a.t, '^[0-9]{5,6}$') AND regexp_matches(b.t, '^[0-9]{1,4}$')",
    "c5": _channel("c5k", K.key_cap, "1.0::DOUBLE"),
    "n3r": f"SELECT *, row_number() OVER (PARTITION BY country, id ORDER BY df, token) AS rn FROM nt JOIN ndf USING (country, token) WHERE df >= {K.df_floor}",
    "n3": _pairs("n3r"),
    "c3": _channel("n3", K.key_cap, "count(*) / 3.0::DOUBLE"),
    "a4d": f"SELECT *, CASE WHEN regexp_matches(token, '[0-9]') THEN 0 ELSE 1 END AS w, row_number() OVER (PARTITION BY country, id, CASE WHEN regexp_matches(token, '[0-9]') THEN 0 ELSE 1 END ORDER BY df, token) AS dn FROM atk JOIN adf USING (country, token) WHERE df >= {K.df_floor}",
    "a4r": f"SELECT *, row_number() OVER (PARTITION BY country, id ORDER BY w, df, token) AS rn FROM a4d WHERE w = 1 OR dn <= {K.max_digit_tokens}",
    "a4": _pairs("a4r"),
    "c4": _channel("a4", K.key_cap, "count(*) / 3.0::DOUBLE"),
    "long": " UNION ALL ".join(f"SELECT country, q, c, '{n}' AS ch, score FROM {t}" for n, t in CHANNELS.items()),
    "uni": "SELECT country, q, c, " + ", ".join(f"coalesce(max(score) FILTER (ch = '{n}'), 0.0::DOUBLE) AS {n}" for n in CHANNELS) + " FROM long GROUP BY ALL",
    "cand": f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY country, q ORDER BY max_chan DESC, c) AS rn FROM (SELECT *, greatest({', '.join(CHANNELS)}) AS max_chan FROM uni)) WHERE rn <= {K.candidate_cap}",
    "grams": "SELECT *, replace(name, ' ', '') AS t FROM r",
    "sets": """SELECT country, id, name, length(name) AS len, list_filter(list_distinct(string_split(name, ' ')), lambda v: v <> '') AS n, list_filter(list_distinct(string_split(addr, ' ')), lambda v: v <> '') AS a,
      list_filter(list_distinct(list_concat(string_split(name, ' '), string_split(addr, ' '))), lambda v: regexp_matches(v, '^[0-9]')) AS d, list_distinct(list_transform(range(1, greatest(length(t) - 2, 1)), lambda i: substr(t, i, 4))) AS g FROM grams""",
    "ps": """SELECT p.*, x.name AS xname, x.len AS xlen, x.n AS xn, x.a AS xa, x.d AS xd, x.g AS xg, y.name AS yname, y.len AS ylen, y.n AS yn, y.a AS ya, y.d AS yd, y.g AS yg FROM cand p
      JOIN sets x ON p.country = x.country AND p.q = x.id JOIN sets y ON p.country = y.country AND p.c = y.id""",
    "sf": f"""SELECT country, q, c, round({jac('n')}, 6) AS nm_jac, round({cont('n')}, 6) AS nm_cont, round({jac('g')}, 6) AS nm_4gram, CAST(xname = yname AND xlen > 0 AS INTEGER) AS nm_exact,
      round({ratio('least(xlen, ylen)', 'greatest(xlen, ylen)')}, 6) AS nm_lenratio, round({jac('a')}, 6) AS ad_jac, round({cont('a')}, 6) AS ad_cont, CAST(len(xa) = 0 AS INTEGER) AS ad_empty_q, CAST(len(ya) = 0 AS INTEGER) AS ad_empty_c FROM ps""",
    "df_": f"SELECT country, q, c, round({jac('d')}, 6) AS dg_jac, CAST(len(list_intersect(xd, yd)) AS INTEGER) AS dg_shared, CAST(len(xd) > 0 AND len(yd) > 0 AS INTEGER) AS dg_both_have FROM ps",
    "sc": "SELECT country, q, c, least(0.99::DOUBLE, round(0.5::DOUBLE * nm_jac + 0.5::DOUBLE * ad_jac, 4)) AS p FROM sf",
    "pz": "SELECT country, q, coalesce(z, 1.0::DOUBLE) AS p_zero FROM ent LEFT JOIN (SELECT country, q, CASE WHEN max(p) >= 1 THEN 0.0::DOUBLE ELSE exp(sum(ln(1 - p))) END AS z FROM sc GROUP BY ALL) USING (country, q)",
    "acc": accept("sc", "pz"),
    "own": "SELECT country, c, owner FROM (SELECT a.country, b.id AS c, a.id AS owner, row_number() OVER (PARTITION BY a.country, b.id ORDER BY abs(CAST(substr(a.id, 4) AS BIGINT) - CAST(substr(b.id, 4) AS BIGINT)), a.id) AS rn "
    "FROM r a JOIN r b ON a.country = b.country AND a.name = b.name WHERE a.src = 1 AND b.src <> 1) WHERE rn = 1",
    "truth": "SELECT country, owner AS q, c FROM own",
    "es": "",
    "near": _cosine("npost", K.name_top_k, "="),
    "err": "SELECT s.*, CAST(t.c IS NOT NULL AS INTEGER) AS yes, CAST(a.c IS NOT NULL AS INTEGER) AS got, row_number() OVER (PARTITION BY s.country, s.q ORDER BY s.p DESC, s.c) - 1 AS rank FROM sc s LEFT JOIN truth t ON s.country = t.country AND s.q = t.q AND s.c = t.c LEFT JOIN acc a ON s.country = a.country AND s.q = a.q AND s.c = a.c",
    "pairs": "SELECT p.country, p.q, p.c, x.name AS x, y.name AS y, x.addr AS xa, y.addr AS ya FROM cand p JOIN r x ON p.country = x.country AND p.q = x.id JOIN r y ON p.country = y.country AND p.c = y.id",
    "tp": "SELECT p.country, p.q, p.c, x.addr AS x, y.addr AS y FROM truth p JOIN r x ON p.country = x.country AND p.q = x.id JOIN r y ON p.country = y.country AND p.c = y.id",
    "lsd": "",
    "own2": "SELECT country, q, c FROM (SELECT b.country, b.id AS c, a.id AS q, row_number() OVER (PARTITION BY b.country, b.id ORDER BY a.id) AS rn FROM r a JOIN r b ON a.country = b.country AND a.k // 50 = b.k // 50 WHERE a.src = 1 AND b.src <> 1) WHERE rn = 1",
    "err2": "SELECT s.*, CAST(t.c IS NOT NULL AS INTEGER) AS yes, CAST(a.c IS NOT NULL AS INTEGER) AS got, row_number() OVER (PARTITION BY s.country, s.q ORDER BY s.p DESC, s.c) - 1 AS rank FROM sc s LEFT JOIN own2 t ON s.country = t.country AND s.q = t.q AND s.c = t.c LEFT JOIN acc a ON s.country = a.country AND s.q = a.q AND s.c = a.c",
    "lsd2": "",
}


def entity(accepted: str, truth: str = "truth") -> str:
    """(country, q, hit, n, k, f) of each entity."""
    return f"""SELECT country, q, hit, n, k, CASE WHEN n = 0 AND k = 0 THEN 1.0::DOUBLE WHEN 0.25::DOUBLE * n + k > 0 THEN 1.25::DOUBLE * hit / (0.25::DOUBLE * n + k) ELSE 0.0::DOUBLE END AS f FROM (
      SELECT e.country, e.q, coalesce(h.hit, 0) AS hit, coalesce(t.n, 0) AS n, coalesce(a.k, 0) AS k FROM ent e
      LEFT JOIN (SELECT country, q, count(DISTINCT c) AS k FROM {accepted} GROUP BY ALL) a ON e.country = a.country AND e.q = a.q
      LEFT JOIN (SELECT country, q, count(DISTINCT c) AS n FROM {truth} GROUP BY ALL) t ON e.country = t.country AND e.q = t.q
      LEFT JOIN (SELECT country, q, count(DISTINCT c) AS hit FROM {accepted} JOIN {truth} USING (country, q, c) GROUP BY ALL) h ON e.country = h.country AND e.q = h.q)"""


TABLES["es"] = entity("acc")


def least(links: str) -> str:
    one = "(SELECT l.country, l.q, l.c, min(d.df) AS m FROM {links} l JOIN {t} a ON l.country = a.country AND l.q = a.id JOIN {t} b ON l.country = b.country AND l.c = b.id AND a.token = b.token JOIN {d} d ON d.country = a.country AND d.token = a.token GROUP BY ALL)"
    return f"SELECT l.country, l.q, l.c, n.m AS name_df, a.m AS addr_df FROM {links} l LEFT JOIN {one.format(links=links, t='nt', d='ndf')} n ON l.country = n.country AND l.q = n.q AND l.c = n.c LEFT JOIN {one.format(links=links, t='atk', d='adf')} a ON l.country = a.country AND l.q = a.q AND l.c = a.c"


TABLES["lsd"] = least("truth")
TABLES["lsd2"] = least("own2")


def sql(select: str, **more: str) -> str:
    """The statement with those common tables that it needs, in their order."""
    import re

    tables = {**TABLES, **more}
    need, todo = set(), [select]
    while todo:
        words = set(re.findall(r"[a-z_0-9]+", todo.pop()))
        for name in tables:
            if name in words and name not in need:
                need.add(name)
                todo.append(tables[name])
    kept = [f"{name} AS ({body})" for name, body in tables.items() if name in need]
    return ("WITH " + ", ".join(kept) + " " if kept else "") + select
