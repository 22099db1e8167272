"""The views that the queries use."""

from __future__ import annotations

from datetime import timedelta

from ..definitions import Aggregation, Entity, EventSource, FeatureView, Function, KeyType, Registry, ResolutionLadder, Tier

HOUR, DAY = timedelta(hours=1), timedelta(days=1)
USER = Entity("user", "user_id", KeyType.INT64)
ITEM = Entity("item", "item_id", KeyType.INT64)
KIND = Entity("kind", "event_type", KeyType.STRING)
CUSTOMER = Entity("customer", "o_custkey", KeyType.INT64)
ENGAGEMENT = EventSource("engagement", "engagement_events", "engagement.events", "event_ms", "created_ms")
ORDERS = EventSource("orders", "order_events", "order.events", "event_ms", "created_ms")


def _user(name: str, longest: timedelta, entities=(USER,), ttl: timedelta | None = None) -> FeatureView:
    some = lambda *ws: tuple(w for w in ws if w <= longest)
    return FeatureView(
        name,
        entities,
        ENGAGEMENT,
        (
            Aggregation(Function.SUM, some(HOUR, DAY, 7 * DAY), "watch_seconds"),
            Aggregation(Function.COUNT, some(HOUR, DAY)),
            Aggregation(Function.SUM, some(DAY, 7 * DAY), "liked"),
            Aggregation(Function.AVG, some(DAY), "watch_seconds"),
        ),
        ttl or longest,
    )


USER_ENGAGEMENT = _user("user_engagement", 7 * DAY)
#: The data's gaps are short, so staleness shows only with a ttl of a day.
USER_DAY = _user("user_day", DAY)
USER_KIND = _user("user_kind", 7 * DAY, (USER, KIND))
ITEM_ENGAGEMENT = FeatureView(
    "item_engagement",
    (ITEM,),
    ENGAGEMENT,
    (Aggregation(Function.SUM, (HOUR, DAY), "watch_seconds"), Aggregation(Function.SUM, (HOUR, DAY), "shared"), Aggregation(Function.MAX, (DAY,), "watch_seconds")),
    DAY,
)
CUSTOMER_ORDERS = FeatureView(
    "customer_orders",
    (CUSTOMER,),
    ORDERS,
    (Aggregation(Function.MIN, (364 * DAY,), "o_totalprice"), Aggregation(Function.MAX, (364 * DAY,), "o_totalprice"), Aggregation(Function.SUM, (728 * DAY,), "o_totalprice"), Aggregation(Function.COUNT, (364 * DAY,))),
    728 * DAY,
    ladder=ResolutionLadder((Tier(364 * DAY, DAY), Tier(728 * DAY, 7 * DAY))),
)
REGISTRY = Registry((USER_ENGAGEMENT, USER_DAY, USER_KIND, ITEM_ENGAGEMENT, CUSTOMER_ORDERS))
