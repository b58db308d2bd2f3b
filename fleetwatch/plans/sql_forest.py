"""SQL that grows the isolation forest of the registered study from the feature table and walks it."""

from __future__ import annotations

from fleetwatch.functions.hashing import HASH_SPACE
from fleetwatch.models.boosting import Boosting
from fleetwatch.models.forest import LEAST_RANGE, ROWS_PER_TREE, TREES, forest_depth
from fleetwatch.plans.sql import compose, hash32
from fleetwatch.plans.sql_boosting import DEVICES, NUMERIC, prepared
from fleetwatch.plans.stages import SPLIT

SEED = 42
DEPTH = forest_depth(ROWS_PER_TREE)


def _average(n: str) -> str:
    """Average path length among n points."""
    return f"""case when {n} <= 1 then 0.0 when {n} = 2 then 1.0
    else 2.0 * (ln({n} - 1) + 0.57721566490153286) - 2.0 * ({n} - 1) / {n} end"""


def _values(table: str, where: str) -> str:
    """(place, k, v) of the rows of a split, missing numbers filled with the medians of the training rows."""
    key = "concat(serial_number, ':', strftime(obs_date, '%Y-%m-%d'))"
    numbers = [
        f"select {i} as place, {key} as k, cast(coalesce(t.{c}, m.{c}) as double) as v from features t, middle m where {where}"
        for i, c in enumerate(NUMERIC)
    ]
    texts = [
        f"select {len(NUMERIC) + i}, {key}, case when model = '{d}' then 1.0 else 0.0 end from features where {where}"
        for i, d in enumerate(DEVICES)
    ]
    return f"{table} as materialized (\n  " + "\n  union all ".join([*numbers, *texts]) + ")"


def grown() -> list[str]:
    """CTEs of samples and of the nodes of every level, for trees that a table ``trees`` names."""
    draw = hash32(f"concat(k, ':{SEED}:', cast(tree as varchar))")
    parts = [
        _values("healthy", f"obs_date < date '{SPLIT.train_cut}' and will_fail_30d = 0"),
        f"""at_0 as materialized (
  select tree, k, 1 as node from (select distinct k from healthy), trees
  qualify row_number() over (partition by tree order by {draw}, k) <= {ROWS_PER_TREE})""",
        f"""spread as materialized (
  select place, case when place < {len(NUMERIC)} then stddev_samp(v) else 1 end as deviation from long group by place)""",
        "sampled as (select cast(count(*) as double) / count(distinct tree) as size from at_0)",
    ]
    for level in range(DEPTH):
        feature, part = (
            hash32(f"concat('{SEED}:', cast(tree as varchar), ':', cast(node as varchar), ':{what}')")
            for what in ("feature", "threshold")
        )
        parts += [
            f"""sizes_{level} as (
  select tree, node, count(*) as n from at_{level} where node >= {1 << level} group by tree, node)""",
            f"""ranges_{level} as (
  select a.tree, a.node, h.place, min(h.v) as low, max(h.v) as high
  from at_{level} a join healthy h on a.k = h.k join spread s on h.place = s.place where a.node >= {1 << level}
    and {level} < (select ceil(log2(greatest(size, 2))) from sampled)
  group by a.tree, a.node, h.place having max(h.v) - min(h.v) > {LEAST_RANGE} * max(s.deviation))""",
            f"""splits_{level} as materialized (
  select tree, node, place, low + {part} / {float(HASH_SPACE)} * (high - low) as threshold from ranges_{level}
  qualify row_number() over (partition by tree, node order by place) - 1
          = {feature} % count(*) over (partition by tree, node))""",
            f"""leaves_{level} as (
  select s.tree, s.node, {level} + {_average('n')} as path
  from sizes_{level} s where not exists (select 1 from splits_{level} x where x.tree = s.tree and x.node = s.node))""",
            f"""at_{level + 1} as materialized (
  select a.tree, a.k, case when s.node is null then a.node else 2 * a.node + cast(h.v > s.threshold as int) end as node
  from at_{level} a left join splits_{level} s on a.tree = s.tree and a.node = s.node
    left join healthy h on a.k = h.k and s.place = h.place)""",
        ]
    return [
        *parts,
        f"""leaves_{DEPTH} as (
  select tree, node, {DEPTH} + {_average('n')} as path
  from (select tree, node, count(*) as n from at_{DEPTH} where node >= {1 << DEPTH} group by tree, node))""",
        "inner_nodes as materialized (" + " union all ".join(f"select * from splits_{i}" for i in range(DEPTH)) + ")",
        "leaves as materialized (" + " union all ".join(f"select * from leaves_{i}" for i in range(DEPTH + 1)) + ")",
    ]


def walked() -> list[str]:
    """CTEs that take every test row down every tree, one level a step."""
    steps = [
        _values("tested", f"obs_date >= date '{SPLIT.test_start}' and obs_date <= date '{SPLIT.test_cut}'"),
        """walk as (
  with recursive w(tree, k, node, more) as (
    select tree, k, 1, true from (select distinct k from tested), trees
    union all
    select w.tree, w.k, case when s.node is null then w.node else 2 * w.node + cast(t.v > s.threshold as int) end,
           s.node is not null
    from w left join inner_nodes s on w.tree = s.tree and w.node = s.node
      left join tested t on w.k = t.k and s.place = t.place
    where w.more)
  select tree, k, node from w where not more)""",
        "paths as materialized (select w.tree, w.k, l.path from walk w join leaves l on w.tree = l.tree and w.node = l.node)",
    ]
    return steps


def forest(tail: str, trees: int = TREES, walk: bool = False, doubles=(), dates=()) -> str:
    """A select over the nodes, and the paths of the test rows, of the first trees."""
    named = f"trees as (select cast(range as integer) as tree from range({trees}))"
    parts = [*prepared(Boosting())[:3], named, *grown(), *(walked() if walk else [])]
    return compose("features", tail, *parts, doubles=doubles, dates=dates)


NODES = f"""select tree, cast(sum(leaf + inner_node) as bigint) as nodes, cast(sum(leaf) as bigint) as leaves,
  max(path) as longest
from (select tree, 1 as leaf, 0 as inner_node, path from leaves
      union all select tree, 0, 1, 0.0 from inner_nodes) group by tree"""

SCORES = f"""select f.obs_date, f.serial_number, f.failure_date, f.will_fail_30d,
  pow(2.0, -p.mean_path / (select {_average('size')} from sampled)) - 0.5
    as anomaly_score
from features f join (select k, avg(path) as mean_path from paths group by k) p
  on p.k = concat(f.serial_number, ':', strftime(f.obs_date, '%Y-%m-%d'))"""

PATHS = "select tree, avg(path) as mean_path, min(path) as shortest, max(path) as longest from paths group by tree"
