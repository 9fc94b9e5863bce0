"""Route selection from three classifier scores, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askgrid.functions.lets import let

# The three routes in tie order, the decision thresholds and the margin tolerance.
ROUTES = ("system_direct", "knowledge_base", "clarification")
CONFIDENCE_THRESHOLD = 0.75
AMBIGUITY_MARGIN = 0.10
MARGIN_TOLERANCE = 1e-12
# Fixed value: question shown when the classifier gives none.
DEFAULT_GUIDANCE = "请补充您想了解的具体对象或问题, 以便我准确处理."


def ranked_routes(scores: dict[str, Column]) -> Column:
    """``array<struct<neg, pos, route>>``, best first; ties keep the route order."""
    return F.array_sort(
        F.array(
            *[
                F.struct(
                    (-scores[route].cast("double")).alias("neg"),
                    F.lit(position).alias("pos"),
                    F.lit(route).alias("route"),
                )
                for position, route in enumerate(ROUTES)
            ]
        )
    )


def decide(top: Column, gap: Column, top_route: Column, threshold, margin) -> Column:
    """``struct<route, reason>`` from the best score, its lead and its route."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    margin = margin if isinstance(margin, Column) else F.lit(float(margin))
    short = (gap < margin) & (F.abs(gap - margin) > MARGIN_TOLERANCE)
    reason = (
        F.when(top < threshold, "low_confidence")
        .when(short, "ambiguous")
        .when(top_route == "clarification", "explicit_clarification")
        .otherwise("high_confidence")
    )
    return let(
        reason,
        lambda r: F.struct(
            F.when(r == "high_confidence", top_route).otherwise("clarification").alias("route"),
            r.alias("reason"),
        ),
    )


def score_profile(scores: dict[str, Column]) -> Column:
    """``struct<top, gap, top_route>``: all that the decision depends on."""
    return let(
        ranked_routes(scores),
        lambda r: F.struct(
            (-r[0]["neg"]).alias("top"),
            (r[1]["neg"] - r[0]["neg"]).alias("gap"),
            r[0]["route"].alias("top_route"),
        ),
    )
