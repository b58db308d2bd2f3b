"""SQL that grows the first boosted trees of the registered study from the feature table, step by step.

Bins, draws, gradients, histograms, splits and leaf values are all recomputed; nothing is taken from the learner.
"""

from __future__ import annotations

from fleetwatch.models.boosting import DRAWS, Boosting, drawn_features
from fleetwatch.plans.sql import CHANGE_NAMES, PAIR_NAMES, STAT_NAMES, bucket, compose
from fleetwatch.plans.stages import SPLIT

NUMERIC = ["capacity_bytes", *PAIR_NAMES, *STAT_NAMES, *CHANGE_NAMES]
#: The models of the registered fleet.
DEVICES = [f"M{i}" for i in range(5)]
PLACES = [*NUMERIC, *[f"model_{d}" for d in DEVICES]]


def prepared(chosen: Boosting) -> list[str]:
    """CTEs of the training rows, their values per place of the vector, and their bins."""
    numbers = [
        f"select {i} as place, k, cast(coalesce(t.{c}, m.{c}) as double) as v from train t, middle m"
        for i, c in enumerate(NUMERIC)
    ]
    texts = [
        f"select {len(NUMERIC) + i}, k, case when model = '{d}' then 1.0 else 0.0 end from train"
        for i, d in enumerate(DEVICES)
    ]
    return [
        f"""train as materialized (
  select concat(serial_number, ':', strftime(obs_date, '%Y-%m-%d')) as k, will_fail_30d as y, model, {", ".join(NUMERIC)}
  from features where obs_date < date '{SPLIT.train_cut}')""",
        f"middle as materialized (select {', '.join(f'median({c}) as {c}' for c in NUMERIC)} from train)",
        "long as materialized (\n  " + "\n  union all ".join([*numbers, *texts]) + ")",
        f"""ends as (
  select place, v, cum < total and (cum * {chosen.bins}) // total > ((cum - n) * {chosen.bins}) // total as is_edge
  from (select place, v, count(*) as n, sum(count(*)) over (partition by place order by v) as cum,
               sum(count(*)) over (partition by place) as total from long group by place, v))""",
        """binned as materialized (
  select l.place, l.k, e.bin
  from long l join (select place, v, coalesce(sum(cast(is_edge as int)) over (
                      partition by place order by v rows between unbounded preceding and 1 preceding), 0) as bin
                    from ends) e on l.place = e.place and l.v = e.v)""",
        """units as materialized (
  select ln(cast(sum(y) as double) / sum(1 - y)) as base, pow(2, floor(52 - log2(count(*)))) as scale from train)""",
        "margins_0 as (select k, y, base as margin from train, units)",
    ]


def grown(number: int, chosen: Boosting, seed: int = 42) -> list[str]:
    """CTEs of one round: drawn rows, nodes of every row, splits of every level, leaves, new margins."""
    r = number
    features = drawn_features(len(PLACES), chosen.columns, seed, number)
    draw = bucket(f"concat(k, ':{seed}:{r}')", DRAWS)
    parts = [
        f"""rows_{r} as materialized (
  select k, y, margin, {draw} < {int(chosen.rows * DRAWS)} as drawn,
         round_even((p - y) * scale, 0) / scale as g, round_even(p * (1 - p) * scale, 0) / scale as h
  from (select *, 1 / (1 + exp(-margin)) as p from margins_{r}), units)""",
        f"at_{r}_0 as (select k, 1 as node from rows_{r})",
    ]
    for level in range(chosen.depth):
        parts += [
            f"""sums_{r}_{level} as (
  select a.node, b.place, b.bin, sum(x.g) as g, sum(x.h) as h
  from at_{r}_{level} a join rows_{r} x on a.k = x.k join binned b on a.k = b.k
  where x.drawn and a.node >= {1 << level} and b.place in ({", ".join(map(str, features))})
  group by a.node, b.place, b.bin)""",
            f"""sides_{r}_{level} as (
  select node, place, bin, sum(g) over so_far as lg, sum(h) over so_far as lh, sum(g) over whole as ag, sum(h) over whole as ah
  from sums_{r}_{level}
  window so_far as (partition by node, place order by bin), whole as (partition by node, place))""",
            f"""gains_{r}_{level} as (
  select *, lg * lg / (lh + {chosen.penalty}) + (ag - lg) * (ag - lg) / (ah - lh + {chosen.penalty})
            - ag * ag / (ah + {chosen.penalty}) as gain
  from sides_{r}_{level} where lh >= {chosen.least_hessian} and ah - lh >= {chosen.least_hessian})""",
            f"""splits_{r}_{level} as materialized (
  select * from gains_{r}_{level} where gain > 0
  qualify row_number() over (partition by node order by gain desc, place, bin) = 1)""",
            f"""at_{r}_{level + 1} as materialized (
  select a.k, case when s.node is null then a.node else 2 * a.node + cast(b.bin > s.bin as int) end as node
  from at_{r}_{level} a left join splits_{r}_{level} s on a.node = s.node
    left join binned b on a.k = b.k and s.place = b.place)""",
        ]
    return [
        *parts,
        f"""leaves_{r} as materialized (
  select a.node, sum(x.h) as cover, -sum(x.g) / (sum(x.h) + {chosen.penalty}) * {chosen.rate} as value
  from at_{r}_{chosen.depth} a join rows_{r} x on a.k = x.k where x.drawn group by a.node)""",
        f"""margins_{r + 1} as materialized (
  select x.k, x.y, x.margin + l.value as margin
  from rows_{r} x join at_{r}_{chosen.depth} a on x.k = a.k join leaves_{r} l on a.node = l.node)""",
    ]


def boosted(rounds: int, tail: str | None = None, *more: str, chosen: Boosting | None = None, doubles=("gain", "value", "cover")) -> str:
    """The nodes of the first trees, or another select over the CTEs of so many rounds."""
    chosen = chosen or Boosting()
    names = ", ".join(f"'{n}'" for n in PLACES)
    inner = [
        f"select {r} as tree, node, [{names}][place + 1] as feature, gain, 0.0 as value, ah as cover from splits_{r}_{level}"
        for r in range(rounds)
        for level in range(chosen.depth)
    ]
    outer = [f"select {r}, node, null, 0.0, value, cover from leaves_{r}" for r in range(rounds)]
    whole = f"""select cast(tree as integer) as tree, cast(node as integer) as node, feature, cast(gain as double) as gain,
    cast(value as double) as value, cast(cover as double) as cover from ({" union all ".join([*inner, *outer])})"""
    steps = [c for r in range(rounds) for c in grown(r, chosen)]
    return compose("features", tail or whole, *prepared(chosen), *steps, *more, doubles=list(doubles))
