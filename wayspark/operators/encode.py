"""Trips as cell sequences at several resolutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayspark.config import DEFAULT, Params
from wayspark.functions import geo, seq
from wayspark.functions.frames import with_once


def encode(clean: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """clean with cells_resR, start, end and length for each resolution; each comes
    from the coordinates, not from another resolution. Trips of fewer than two points
    or without cells go."""
    out = clean.where(F.size("coordinates") >= 2)
    out = with_once(out, **{f"__res{res}": geo.encode_all(F.col("coordinates"), edge, p) for res, edge in p.edge_km})
    out = with_once(out, **{f"cells_res{res}": seq.dedup(F.col(f"__res{res}")) for res, _ in p.edge_km})
    for res, _ in p.edge_km:
        c = F.col(f"cells_res{res}")
        out = out.withColumns({f"start_res{res}": c[0], f"end_res{res}": F.element_at(c, -1), f"len_res{res}": F.size(c)}).drop(f"__res{res}")
    return out.drop("num_points_raw") if "num_points_raw" in out.columns else out


def distinct_cells(encoded: DataFrame, res: int) -> DataFrame:
    return encoded.select(F.explode(f"cells_res{res}").alias("cell")).agg(F.count_distinct("cell").alias("n_cells"))


def load_trips(df: DataFrame, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """The mining relation (trip_id, cells, taxi_id, duration_sec, distance_km) from
    whichever of the columns exist, at resolution 9 or else 8; nulls get defaults."""
    have = set(df.columns)
    cells = next(c for c in ("cells", "cells_res9", "cells_res8") if c in have)
    pick = lambda names, kind, default: F.coalesce(*[F.col(n).cast(kind) for n in names if n in have], F.lit(default).cast(kind))
    out = df.select(
        pick(("trip_id", "TRIP_ID"), "string", "").alias("trip_id"),
        seq.dedup(F.coalesce(F.col(cells), F.array().cast("array<string>"))).alias("cells"),
        pick(("taxi_id", "TAXI_ID"), "bigint", 0).alias("taxi_id"),
        pick(("duration_sec",), "bigint", 0).alias("duration_sec"),
        pick(("distance_km",), "double", 0.0).alias("distance_km"),
    )
    return out.sample(False, fraction, seed) if fraction is not None and fraction < 1 else out
