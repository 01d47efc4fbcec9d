"""The grading plan: items to calibrated aspects, draft score, fused and final grade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwise.operators import scoring
from loomwise.plans import items as src
from loomwise.session import materialised


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with sims, aspects, genre, score, confidence and grade.

    What needs no statistics of the batch is written once; the statistics, one
    aggregate, and the rows are both read from there.
    """
    vectors = src.units(spark, sf_dir)
    df = scoring.prompt_similarities(src.items(spark, sf_dir), src.prompts(vectors))
    return scoring.draft_score(scoring.calibrate(materialised(scoring.discriminants(df), "items")))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded items with quality, fineart, archetype weights, fused and final; graded rows are written once, for the second statistics."""
    df = materialised(graded(spark, sf_dir), "graded")
    df = df.withColumns({"q0": scoring.empty_route_quality(F.col("comp"), F.col("light")), "disqualified": F.col("idx") % 23 == 0, "fa0": F.get("sims", F.lit(29))})
    df = scoring.archetype_weights(scoring.batch_stretch(df, "q0", "quality", "fa0", ~F.col("disqualified"), "fineart"))
    df = df.withColumns(
        {
            "over_shoulder": F.col("idx") % 7 == 0,
            "chiaroscuro": scoring.chiaroscuro(F.col("lum"), F.col("lum_std")),
            "soft_person": F.col("idx") % 11 == 0,
            "has_person": F.col("faces") > 0,
        }
    )
    return scoring.finalise(scoring.fuse(df))


_A = ["tech", "comp", "light", "narr", "human"]
_W = {"Street": [0.03, 0.30, 0.18, 0.44, 0.05], "Liminal": [0.03, 0.14, 0.42, 0.38, 0.00], "Architectural": [0.18, 0.44, 0.26, 0.12, 0.00], "FineArt": [0.04, 0.18, 0.42, 0.33, 0.03]}


def _cal(c: str, to: str) -> str:
    return f"least(greatest(({c} - min({c}) OVER ()) / greatest(max({c}) OVER () - min({c}) OVER (), 0.0001) * CAST(0.85 AS DOUBLE) + 0.10, 0.10), 0.95) AS {to}"


#: SQL CTEs up to g: the graded items.
SQL = f"""WITH {src.SQL},
pr AS (SELECT list(v ORDER BY id) AS ps FROM u WHERE id < 36),
s AS (SELECT it.*, list_transform(ps, lambda p: list_inner_product(v, p)) AS sims FROM it, pr),
d AS (SELECT *, list_max(sims[1:14]) - list_max(sims[15:19]) AS overall, {", ".join(f"sims[{20 + k}] - sims[{25 + k}] AS {a}_raw" for k, a in enumerate(_A))} FROM s),
c AS (SELECT *, {_cal("overall", "overall_c")}, {", ".join(_cal(f"{a}_raw", a) for a in _A)} FROM d),
c2 AS (SELECT *, CASE WHEN human < 0.38 AND comp > 0.52 THEN 'Architectural' WHEN human < 0.35 AND (light > 0.50 OR narr > 0.48) THEN 'Liminal' WHEN light > 0.50 AND narr > 0.45 THEN 'FineArt' ELSE 'Street' END AS genre FROM c),
c3 AS (SELECT *, least(greatest(0.60 * (CASE genre {" ".join(f"WHEN '{g}' THEN " + " + ".join(f"CAST({w} AS DOUBLE) * {a}" for w, a in zip(ws, _A, strict=True)) for g, ws in _W.items())} END) + 0.40 * overall_c, 0.15), 0.85) AS score FROM c2),
g AS (SELECT *, least(1.0, 2 * abs(score - 0.5)) AS confidence, CASE WHEN score >= 0.60 THEN 'Strong' WHEN score >= 0.41 THEN 'Mid' ELSE 'Weak' END AS grade FROM c3)"""

_R = ["geo", "night", "lay", "messy", "max"]
_OTHERS = {a: ", ".join(f"w_{b}" for b in _R if b != a) for a in _R}
#: Further CTEs up to f: the fused items.
SQL_FUSED = f"""{SQL},
q0 AS (SELECT *, sqrt(greatest(comp, 0.01) * greatest(light, 0.01)) AS q0, sims[30] AS fa0, idx % 23 = 0 AS disqualified, idx % 7 = 0 AS over_shoulder, idx % 11 = 0 AS soft_person, faces > 0 AS has_person, lum < 35 AND lum_std > 35 AS chiaroscuro FROM g),
q1 AS (SELECT *, least(greatest((q0 - min(q0) OVER ()) / greatest(max(q0) OVER () - min(q0) OVER (), 0.0001) * CAST(0.80 AS DOUBLE) + 0.20, 0.20), 1.0) AS quality,
       least(greatest((fa0 - min(fa0) FILTER (WHERE NOT disqualified) OVER ()) / greatest(max(fa0) FILTER (WHERE NOT disqualified) OVER () - min(fa0) FILTER (WHERE NOT disqualified) OVER (), 0.000001), 0.0), 1.0) AS fineart FROM q0),
x0 AS (SELECT *, {", ".join(f"exp(least(greatest(sims[{31 + k}], -1.0), 1.0) / 0.42) AS x_{a}" for k, a in enumerate(_R) if a != "messy")}, CASE WHEN sims[35] > sims[34] THEN 0.0 ELSE exp(sims[34] / 0.42) END AS x_messy FROM q1),
x1 AS (SELECT *, {", ".join(f"x_{a} / (x_geo + x_night + x_lay + x_messy + x_max) AS w_{a}" for a in _R)} FROM x0),
f0 AS (SELECT *, greatest(w_geo, w_night, w_lay, w_messy, w_max) AS wt,
       CASE WHEN (w_geo = greatest(w_geo, w_night, w_lay, w_messy, w_max) OR w_geo > 0.45) AND human < 0.30 THEN 0.5 * narr ELSE narr END AS n_eff FROM x1),
f1 AS (SELECT *, (w_night = wt AND w_night > greatest({_OTHERS["night"]}) + 0.05) OR (w_night > 0.35 AND lum / 2.55 < 30) AS night, w_max = wt AS maxg,
       w_messy > 0.40 OR ((w_geo > w_messy)::INT + (w_night > w_messy)::INT + (w_lay > w_messy)::INT + (w_max > w_messy)::INT = 1 AND comp < 0.35) AS messy,
       w_geo * (0.40 * comp + 0.30 * light + 0.30 * quality) + w_night * (0.35 * human + 0.35 * greatest(comp, 0.70) + 0.20 * quality + 0.075) + w_lay * (0.40 * quality + 0.30 * human + 0.30 * n_eff)
         + w_messy * greatest(0.0, 0.35 * quality + 0.65 * quality - 0.08) + w_max * (0.45 * human + 0.35 * n_eff + 0.20 * quality) AS b FROM f0),
f2 AS (SELECT *, CASE WHEN night AND quality >= 0.52 THEN greatest(b, 0.62) ELSE b END AS b1, CASE WHEN night AND quality < 0.52 THEN 0.42 ELSE 1.0 END AS cap1 FROM f1),
f3 AS (SELECT *, CASE WHEN maxg AND quality >= 0.55 AND light >= 0.35 THEN greatest(b1, 0.64) ELSE b1 END AS b2,
       CASE WHEN maxg AND NOT (quality >= 0.55 AND light >= 0.35) AND (quality < 0.45 OR light < 0.25) THEN least(cap1, 0.38) ELSE cap1 END AS cap FROM f2),
f4 AS (SELECT *, CASE WHEN chiaroscuro OR ((lum < 40 OR lum_std < 30) AND quality >= 0.556) THEN 0.75 * b2 + 0.25 * fineart ELSE b2 END AS b3 FROM f3),
f5 AS (SELECT *, CASE WHEN soft_person AND NOT chiaroscuro THEN b3 - 0.15 ELSE b3 END AS b4 FROM f4),
f6 AS (SELECT *, CASE WHEN quality >= 0.72 OR fineart >= 0.75 OR (human >= 0.70 AND narr >= 0.60) THEN greatest(b4, 0.65) ELSE b4 END AS b5 FROM f5),
f7 AS (SELECT *, CASE WHEN messy THEN least(b5, 0.49) ELSE b5 END AS b6 FROM f6),
f8 AS (SELECT *, least(CASE WHEN w_geo > 0.50 AND human < 0.25 THEN least(b6, 0.52) ELSE b6 END, cap) AS b7, 0.40 * quality + 0.30 * human + 0.30 * narr AS ov FROM f7),
f9 AS (SELECT *, least(greatest(CASE WHEN disqualified THEN 0.0 WHEN human >= 0.65 AND comp < 0.35 AND over_shoulder THEN CASE WHEN human >= 0.70 AND narr >= 0.60 THEN greatest(ov, 0.65) ELSE ov END
       WHEN NOT has_person THEN 0.40 * comp + 0.30 * light + 0.30 * quality ELSE b7 END, 0.0), 1.0) AS fused FROM f8),
f10 AS (SELECT *, 0.80 * fused + 0.20 * personal AS pb FROM f9),
f11 AS (SELECT *, least(greatest(CASE WHEN fineart > 0.68 AND pb >= 0.42 THEN least(greatest(pb + 0.15, 0.0), 1.0) ELSE pb END, 0.10), 1.0) AS final FROM f10),
f AS (SELECT *, CASE WHEN final >= 0.60 THEN 'Strong' WHEN final >= 0.41 THEN 'Mid' ELSE 'Weak' END AS final_grade FROM f11)"""
