"""Common table expressions of the terrain queries' SQL, for DuckDB."""

ORD = "ord AS (SELECT o_orderkey // 125 + 1 AS i, o_orderkey % 125 + 1 AS j, CAST(round_even(o_totalprice * 100 / 250, 0) AS BIGINT) AS z FROM orders)"
EMB = """emb AS (SELECT vec_id + 1 AS i, CAST(p AS BIGINT) AS j, CAST(round_even(CAST(embedding[p] AS DOUBLE) * 1000, 0) AS BIGINT) AS z
  FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(p))"""
POINTS = "points AS (SELECT c_custkey AS id, 43940 + (c_custkey * 37) % 1400 AS e, 6908987 + (c_custkey * 91) % 1400 AS n FROM customer)"


def around(source: str, name: str = "nb", z: str = "z") -> str:
    """The 3 x 3 neighbourhood of z, edges repeated."""
    return f"""{name}_row AS (SELECT i, j, {z} AS z, coalesce(lag({z}) OVER r, {z}) AS w, coalesce(lead({z}) OVER r, {z}) AS e FROM {source} WINDOW r AS (PARTITION BY i ORDER BY j)),
{name} AS (SELECT i, j, z, w, e, coalesce(lag(z) OVER c, z) AS n, coalesce(lag(w) OVER c, w) AS nw, coalesce(lag(e) OVER c, e) AS ne,
  coalesce(lead(z) OVER c, z) AS s, coalesce(lead(w) OVER c, w) AS sw, coalesce(lead(e) OVER c, e) AS se FROM {name}_row WINDOW c AS (PARTITION BY j ORDER BY i))"""


def gradient(source: str, name: str, z: str = "z", carry: str = "") -> str:
    """Twelve times the gradient."""
    return f"""{around(source, name + "_nb", z)},
{name} AS (SELECT i, j, z, sw - nw + 4 * (s - n) + se - ne AS g1, ne - nw + 4 * (e - w) + se - sw AS g2 FROM {name}_nb)"""


def hessian(source: str, z: str = "z") -> str:
    return f"""{gradient(source, "gr", z)},
{gradient("gr", "ga", "g1")},
{gradient("gr", "gb", "g2")},
hs AS (SELECT gr.i, gr.j, gr.z, ga.g1 AS h11, ga.g2 AS h12, gb.g1 AS h21, gb.g2 AS h22 FROM gr JOIN ga USING (i, j) JOIN gb USING (i, j))"""


def sheets(s) -> str:
    """sh(sheet, row, col, ...) of a MapSpec."""
    return f"""sh AS (SELECT CAST(k AS INTEGER) AS sheet, CAST((k - 1) % {s.nrows} + 1 AS INTEGER) AS row, CAST((k - 1) // {s.nrows} + 1 AS INTEGER) AS col,
  CAST(((k - 1) // {s.nrows}) * {s.nx} AS INTEGER) AS opx, CAST(({s.nrows} - 1 - (k - 1) % {s.nrows}) * {s.ny} AS INTEGER) AS opy,
  CAST({s.sw_e} + ((k - 1) // {s.nrows}) * {s.sheet_width} AS BIGINT) AS min_x, CAST({s.sw_n} + ((k - 1) % {s.nrows}) * {s.sheet_height} AS BIGINT) AS min_y,
  CAST({s.sw_e} + ((k - 1) // {s.nrows} + 1) * {s.sheet_width} AS BIGINT) AS max_x, CAST({s.sw_n} + ((k - 1) % {s.nrows} + 1) * {s.sheet_height} AS BIGINT) AS max_y
  FROM range(1, {len(s) + 1}) AS r(k))"""


#: A tree over orders: each key's parent is a third of it, heights grow with keys.
TREE = "tree AS (SELECT o_orderkey + 1 AS id, o_orderkey // 3 + 1 AS parent, CAST(10 * o_orderkey + o_custkey % 10 AS BIGINT) AS z FROM orders)"
