"""Rolling grid state and the features that look at other slots and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.functions.geo import grid_cell

STATE = ("glon", "glat", "slot_ord")
VALUES = ("max_bt07_k", "max_t713_k", "n_cand", "max_area")
LAGS = (-6, -3, -2, -1, 1, 2, 3)


def gridded(candidates: DataFrame, degrees: float) -> DataFrame:
    return candidates.withColumns({"glon": grid_cell("center_lon", degrees), "glat": grid_cell("center_lat", degrees)})


def grid_state(candidates: DataFrame, degrees: float = 0.05) -> DataFrame:
    """Candidates (center_lon, center_lat, slot_ord, max_bt07_k, max_t713_k, cand_area) summed up per cell and slot."""
    return gridded(candidates, degrees).groupBy(*STATE).agg(
        F.max("max_bt07_k").alias("max_bt07_k"), F.max("max_t713_k").alias("max_t713_k"), F.count("*").alias("n_cand"),
        F.max("cand_area").alias("max_area")
    )


def merge_state(old: DataFrame, new: DataFrame, replace: bool = True) -> DataFrame:
    """State with new slots. A slot that comes again replaces the old one, so a replay changes nothing; without
    ``replace`` the candidates of both are added up."""
    if replace:
        old = old.join(new.select("slot_ord").distinct(), "slot_ord", "left_anti").select(*STATE, *VALUES)
    both = old.select(*STATE, *VALUES).unionByName(new.select(*STATE, *VALUES))
    return both.groupBy(*STATE).agg(
        F.max("max_bt07_k").alias("max_bt07_k"), F.max("max_t713_k").alias("max_t713_k"),
        F.sum("n_cand").alias("n_cand"), F.max("max_area").alias("max_area")
    )


def latest_slots(state: DataFrame, keep: int = 400) -> DataFrame:
    """The rows of the latest ``keep`` slots; only the distinct slots are ranked."""
    last = state.select("slot_ord").distinct().orderBy(F.desc("slot_ord")).limit(keep)
    return state.join(last, "slot_ord", "left_semi")


def lag_features(
    candidates: DataFrame, state: DataFrame, key: str, lags: tuple[int, ...] = LAGS, degrees: float = 0.05
) -> DataFrame:
    """Values of the candidate's cell in other slots, missing ones as 0, and persistence from them. One join on the cell
    and slot reached, then one aggregation by candidate. A positive lag looks ahead: it is 0 unless the state holds later
    slots, as in a replay."""
    c = gridded(candidates, degrees)
    probe = c.select(
        key, "glon", "glat", F.col("slot_ord").alias("_slot"),
        F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag")
    ).withColumn("slot_ord", F.col("_slot") + F.col("lag"))
    hit = probe.join(state.select(*STATE, *VALUES), list(STATE))
    tag = lambda k: f"m{-k}" if k < 0 else f"p{k}"
    value = lambda k, v: F.max(F.when(F.col("lag") == k, F.col(v))).alias(f"{v}_{tag(k)}")
    wide = hit.groupBy(key).agg(*[value(k, v) for k in lags for v in VALUES])
    out = c.join(wide, key, "left")
    names = {"max_bt07_k": "temp_bt07", "max_t713_k": "temp_t713", "n_cand": "temp_n", "max_area": "temp_area"}
    out = out.select(
        *c.columns,
        *[
            F.coalesce(
                F.col(f"{v}_{tag(k)}"), F.lit(0)
            ).cast("double").alias(f"{names[v]}_{tag(k)}") for k in lags for v in VALUES
        ]
    )
    past = [f"temp_bt07_{tag(k)}" for k in lags if k < 0]
    out = out.withColumns({f"temp_hit_{tag(k)}": (F.col(f"temp_n_{tag(k)}") > 0).cast("int") for k in lags})
    total = lambda cols: sum((F.col(x) for x in cols), F.lit(0))
    out = out.withColumns({
        "temp_persist_3": total([f"temp_hit_{tag(k)}" for k in (-1, -2, -3) if k in lags]),
        "temp_persist_all": total([f"temp_hit_{tag(k)}" for k in lags]),
        **(
            {
                "temp_bt07_delta_m1": F.col("max_bt07_k") - F.col("temp_bt07_m1"),
                "temp_t713_delta_m1": F.col("max_t713_k") - F.col("temp_t713_m1")
            }
            if -1 in lags else {}
        ),
        **({"temp_bt07_past_max": F.greatest(*past) if len(past) > 1 else F.col(past[0])} if past else {}),
    })
    if past:
        out = out.withColumn(
            "temp_bt07_vs_past_max", F.col("max_bt07_k") / F.greatest("temp_bt07_past_max", F.lit(1e-3))
        )
    hot = F.col("temp_persist_3") * F.log1p(
        F.greatest("max_bt07_k", F.lit(0.0))
    ) * F.log1p(F.greatest("max_t713_k", F.lit(0.0)))
    return out.withColumn("temp_hot_persist", hot)


def neighbour_features(candidates: DataFrame, state: DataFrame, key: str, degrees: float = 0.05) -> DataFrame:
    """Greatest values of the 3 x 3 cells around the candidate in the slot before; 0 where there are none."""
    c = gridded(candidates, degrees) if "glon" not in candidates.columns else candidates
    around = F.explode(
        F.array(
            *[
                F.struct(
                    (F.col("glon") + x).alias("glon"), (F.col("glat") + y).alias("glat")
                ) for x in (-1, 0, 1) for y in (-1, 0, 1)
            ]
        )
    )
    probe = c.select(key, (F.col("slot_ord") - 1).alias("slot_ord"), around.alias("_n")).select(key, "slot_ord", "_n.*")
    near = probe.join(state, list(STATE)).groupBy(key).agg(F.max("max_bt07_k").alias("_b"), F.max("n_cand").alias("_n"))
    out = c.join(near, key, "left")
    return out.withColumns(
        {
            "temp_nb_bt07_m1": F.coalesce("_b", F.lit(0.0)), "temp_nb_n_m1": F.coalesce("_n", F.lit(0)),
            "temp_nb_hit_m1": F.coalesce((F.col("_n") > 0).cast("int"), F.lit(0))
        }
    ).drop("_b", "_n")
