"""The mixture's words for each document as DuckDB SQL: the same arithmetic, written as common table expressions."""

from __future__ import annotations

import re

from acreledger.llm.mixing import BLOCK, CONSTANT, FACTOR, PASSES, PRIME, ROUNDS, RUN, SHARD_SLOTS, hashed, wide


def ported(expression: str) -> str:
    return re.sub(r"(\d)L\b", r"\1", expression).replace(" div ", " // ")


def permuted_sql(x: str, size: str, key: str) -> str:
    turn = f"({key} * 31 + r * r * {CONSTANT}) % {PRIME} * 2147483648 + ({key} + r * {FACTOR}) % {PRIME} - x"
    y = f"(greatest(x, p) % {PRIME} + greatest(x, p) // {PRIME} * 31 + {key} + r * 7919) % {PRIME}"
    bit = f"list_transform([{y}], lambda y: (y * y % {PRIME} * y + {FACTOR} * y) % {PRIME} // 65536 % 2)[1]"
    step = f"list_transform([(({turn}) % {size} + {size}) % {size}], lambda p: CASE WHEN {bit} = 1 THEN p ELSE x END)[1]"
    return f"list_reduce(range(1, {ROUNDS + 1}), lambda x, r: {step}, {x})"


def taken_sql(block: int = BLOCK, passes: int = PASSES, seed: int = 1) -> str:
    return rf"""
WITH units AS (
  SELECT source, doc_id AS key, coalesce(md5(text), '') AS digest, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, count(*) AS copies
  FROM documents GROUP BY ALL
), sizes AS (
  SELECT source, CAST(sum(size * copies) AS BIGINT) AS size, CAST(sum(copies) AS BIGINT) AS rows FROM units GROUP BY source
), placed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place, size * {passes} AS most FROM sizes
), weighed AS (
  SELECT *, (place - 1) % 3 + 1 AS weight, sum(size) OVER () AS total FROM placed
), level AS (
  SELECT *, total - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares FROM weighed
), judged AS (
  SELECT *, CAST(most AS HUGEINT) * shares <= CAST(rest AS HUGEINT) * weight AS is_full FROM level
), aimed AS (
  SELECT *, CASE WHEN is_full THEN CAST(most AS DOUBLE)
                 ELSE CAST(total - coalesce(sum(CASE WHEN is_full THEN most END) OVER (), 0) AS DOUBLE) * weight / sum(CASE WHEN NOT is_full THEN weight END) OVER () END AS target,
         (size + {block - 1}) // {block} AS blocks FROM judged
), quotas AS (
  SELECT *, CASE WHEN size > 0 THEN least(CAST(floor(target * blocks / size + 0.5) AS BIGINT), blocks * {passes}) ELSE 0 END AS quota FROM aimed
), sources AS MATERIALIZED (
  SELECT place, source, size, rows, target, blocks, quota, CAST(coalesce(sum(quota) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS quota_from FROM quotas
), runs AS (
  SELECT s.place, ceil(sqrt(s.rows)) AS parts, u.key, u.digest, u.size, run, least({RUN}, u.copies - run * {RUN}) AS many, md5(concat_ws('|', u.key, u.digest, run)) AS name
  FROM (SELECT *, unnest(range(0, (copies - 1) // {RUN} + 1)) AS run FROM units) u JOIN sources s ON u.source IS NOT DISTINCT FROM s.source
), laid_runs AS (
  SELECT *, CAST(coalesce(sum(many * size) OVER (PARTITION BY place ORDER BY CAST('0x' || name[1:8] AS BIGINT) % CAST(parts AS BIGINT), name, key NULLS FIRST, digest, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM runs
), laid AS MATERIALIZED (
  SELECT place, key, digest, size, run * {RUN} + c AS copy, before + c * size AS spot FROM (SELECT *, unnest(range(0, many)) AS c FROM laid_runs)
), whole AS (
  SELECT CAST(coalesce(sum(quota), 0) AS BIGINT) AS n, greatest({SHARD_SLOTS}, CAST(floor(sqrt(coalesce(sum(quota), 0))) AS BIGINT) + 1) AS shard_slots FROM sources
), slots AS (
  SELECT id, id // shard_slots AS shard, {ported(wide("id", seed, "greatest(n, 1)"))} AS draw FROM (SELECT n, shard_slots, unnest(range(0, n)) AS id FROM whole)
), drawn AS MATERIALIZED (
  SELECT id, shard, place, row_number() OVER (PARTITION BY place ORDER BY id) - 1 AS j
  FROM slots JOIN sources ON draw >= quota_from AND draw < quota_from + quota
), counts AS (
  SELECT s.place, s.blocks, s.quota, coalesce(d.n, 0) AS n FROM sources s LEFT JOIN (SELECT place, count(*) AS n FROM drawn GROUP BY place) d USING (place)
), totals AS (
  SELECT *, greatest(quota - n, 0) AS lack, coalesce(sum(greatest(n - quota, 0)) OVER w, 0) AS surplus_from, coalesce(sum(greatest(quota - n, 0)) OVER w, 0) AS lack_from
  FROM counts WINDOW w AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), numbered AS (
  SELECT d.id, d.place, d.j, CASE WHEN d.j >= t.quota THEN t.surplus_from + d.j - t.quota END AS over_ FROM drawn d JOIN totals t USING (place)
), moved AS (
  SELECT d.id, coalesce(t.place, d.place) AS place, CAST(coalesce(t.n + d.over_ - t.lack_from, d.j) AS BIGINT) AS j
  FROM numbered d LEFT JOIN totals t ON d.over_ >= t.lack_from AND d.over_ < t.lack_from + t.lack
), keyed AS (
  SELECT m.place, m.j % t.blocks AS nth, t.blocks, {ported(hashed(f"m.place * {PASSES + 1}L + m.j div t.blocks", f"{seed + 99}L"))} AS key FROM moved m JOIN totals t USING (place)
), taken_blocks AS (
  SELECT place, {permuted_sql("nth", "blocks", "key")} AS block FROM keyed
), pieces AS (
  SELECT *, least(spot + size, (block + 1) * {block}) - greatest(spot, block * {block}) AS n_words
  FROM (SELECT *, unnest(range(spot // {block}, (spot + size - 1) // {block} + 1)) AS block FROM laid WHERE size > 0)
), words AS (
  SELECT p.place, p.key, p.digest, p.copy, sum(p.n_words) AS taken FROM taken_blocks b JOIN pieces p ON p.place = b.place AND p.block = b.block GROUP BY ALL
)
SELECT l.key AS doc_id, l.size, s.size AS source_size, s.target, CAST(coalesce(w.taken, 0) AS BIGINT) AS taken
FROM laid l JOIN sources s USING (place) LEFT JOIN words w ON w.place = l.place AND w.key IS NOT DISTINCT FROM l.key AND w.digest = l.digest AND w.copy = l.copy
"""
