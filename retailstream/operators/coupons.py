"""Coupon abuse: one device, several accounts drawing coupons, nobody looking
at an item.

``alert_windows`` finds the windows from distinct accounts only, without
gathering anything, and ``alert_documents`` / ``alert_members`` then look up
what happened in those windows. Windows that raise no alert are never
assembled. The stream job evaluates its closed panes this way too.

Windows are half open, [start, end), and aligned to the epoch.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import day_of, minute_of

WINDOW_SECONDS = 300
SLIDE_SECONDS = 5
MIN_ACCOUNTS = 3
COUPON = "coupon"
CLICK = "clickItem"


def _floor_div(value: Column, by: int) -> Column:
    """Floor division, also for times before the epoch."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def check_window(window_seconds: int, slide_seconds: int) -> None:
    if window_seconds <= 0 or slide_seconds <= 0 or window_seconds % slide_seconds:
        raise ValueError("the window length must be a multiple of the slide")


def _marks(rows: DataFrame, mid: Column, event: Column, account: Column, click: str, *others: Column) -> DataFrame:
    """The two kinds of events the rule looks at; clicks leave ``account`` NULL."""
    wanted = ((event == COUPON) & account.isNotNull()) | (event == click)
    return rows.filter(wanted).select(
        mid.alias("mid"), *others, F.when(event == COUPON, account).alias("account")
    )


def static_rule(rows: DataFrame, device: str, event: str, account: str, click: str = "click",
                min_accounts: int = MIN_ACCOUNTS) -> DataFrame:
    """``(device, accounts)`` of devices that trip the rule over the whole input."""
    marks = _marks(rows, F.col(device), F.col(event), F.col(account), click).distinct()
    counts = marks.groupBy(F.col("mid").alias(device)).agg(
        F.count("account").cast("int").alias("accounts"),
        F.max(F.col("account").isNull()).alias("clicked"),
    )
    return counts.filter((F.col("accounts") >= min_accounts) & ~F.col("clicked")).drop("clicked")


def alert_windows(
    events: DataFrame,
    window_seconds: int = WINDOW_SECONDS,
    slide_seconds: int = SLIDE_SECONDS,
    min_accounts: int = MIN_ACCOUNTS,
    click: str = CLICK,
) -> DataFrame:
    """``(mid, window_start, window_end, accounts)`` of every alerting window, in epoch ms.

    No mark is copied into each of its windows. Cut the time line into
    stretches of window length. Of the windows that start in a stretch, a mark
    in the same stretch is in the first ones, up to its own time, and a mark in
    the next stretch is in the last ones. So the latest mark here and the
    earliest mark there say which windows an account (or a click) is in, and
    a running sum over the few points where that changes gives the accounts of
    every window.
    """
    check_window(window_seconds, slide_seconds)
    window_ms, slide_ms = window_seconds * 1000, slide_seconds * 1000
    slide = F.lit(slide_ms)

    marks = _marks(events, F.col("mid"), F.col("evid"), F.col("uid"), click, F.col("ts"))
    last_start = F.col("ts") - F.pmod("ts", slide)
    stretch = last_start - F.pmod("ts", F.lit(window_ms)) + F.pmod("ts", slide)
    nothing = F.lit(None).cast("bigint")
    here = F.struct(stretch.alias("stretch"), last_start.alias("upto"), nothing.alias("since"))
    before = F.struct(
        (stretch - window_ms).alias("stretch"),
        nothing.alias("upto"),
        # The first start after ts - window_ms; at the stretch's end it is no start of that stretch.
        F.when(last_start - window_ms + slide < stretch, last_start - window_ms + slide).alias("since"),
    )
    spans = (
        marks.select("mid", "account", F.inline(F.array(here, before)))
        .groupBy("mid", "stretch", "account")
        .agg(F.max("upto").alias("upto"), F.min("since").alias("since"))
    )

    end = F.col("stretch") + window_ms
    leaves = F.col("upto") + slide
    gap = F.col("since").isNull() | (F.col("since") > leaves)
    point = lambda at, step: F.struct(at.alias("at"), F.lit(step).alias("step"))
    points = F.array_compact(
        F.array(
            F.when(F.col("upto").isNotNull(), point(F.col("stretch"), 1)),
            F.when(gap & (leaves < end), point(leaves, -1)),
            F.when(F.col("since").isNotNull() & (gap | F.col("upto").isNull()), point(F.col("since"), 1)),
        )
    )
    is_click = F.col("account").isNull()
    changes = (
        spans.select("mid", "stretch", "account", F.inline(points))
        .groupBy("mid", "stretch", "at")
        .agg(
            F.sum(F.when(is_click, 0).otherwise(F.col("step"))).alias("accounts"),
            F.sum(F.when(is_click, F.col("step")).otherwise(0)).alias("clicks"),
        )
    )
    # At most window/slide points per device and stretch.
    line = Window.partitionBy("mid", "stretch").orderBy("at")
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    constant = changes.select(
        "mid",
        "at",
        F.coalesce(F.lead("at").over(line), end).alias("until"),
        F.sum("accounts").over(so_far).cast("int").alias("accounts"),
        F.sum("clicks").over(so_far).alias("clicks"),
    )
    tripped = constant.filter((F.col("accounts") >= min_accounts) & (F.col("clicks") == 0))
    starts = F.explode(F.sequence("at", F.col("until") - slide, slide.cast("bigint")))
    return tripped.select("mid", starts.alias("window_start"), "accounts").select(
        "mid", "window_start", (F.col("window_start") + window_ms).alias("window_end"), "accounts"
    )


def latest_per_minute(alerts: DataFrame) -> DataFrame:
    """One alert per device and minute of its window end: the latest window."""
    return (
        alerts.groupBy("mid", minute_of("window_end").alias("minute"))
        .agg(
            F.max("window_start").alias("window_start"),
            F.max_by("accounts", "window_end").alias("accounts"),
            F.max("window_end").alias("window_end"),
        )
        .select("mid", "window_start", "window_end", "accounts")
    )


def alert_members(
    events: DataFrame, alerts: DataFrame, window_seconds: int = WINDOW_SECONDS, slide_seconds: int = SLIDE_SECONDS
) -> DataFrame:
    """What happened in each alert window, one row per distinct finding.

    ``(mid, window_start, window_end, kind, member, n)`` with kind ``uid`` or
    ``item`` (of coupon events) or ``event``; ``n`` counts the events behind it.
    Equal events may come counted, with their number in ``n``.

    Events are counted first: per device, stretch of window length and finding,
    the counts of the stretch's slides, window/slide numbers at most. A window
    is the end of one stretch and the beginning of the next, so it meets two such
    rows per finding, and no event is ever paired with a window.
    """
    check_window(window_seconds, slide_seconds)
    window_ms, slide_ms = window_seconds * 1000, slide_seconds * 1000
    weight = F.col("n") if "n" in events.columns else F.lit(1).cast("bigint")
    drawn = F.col("evid") == COUPON
    findings = F.array(
        F.struct(F.lit("event").alias("kind"), F.col("evid").alias("member")),
        F.struct(F.lit("uid").alias("kind"), F.when(drawn, F.col("uid")).alias("member")),
        F.struct(F.lit("item").alias("kind"), F.when(drawn, F.col("itemid")).alias("member")),
    )
    slides = (
        events.select(
            "mid", _floor_div(F.col("ts"), window_ms).alias("stretch"),
            _floor_div(F.pmod("ts", F.lit(window_ms)), slide_ms).alias("slide"), weight.alias("n"), F.inline(findings),
        )
        .filter(F.col("member").isNotNull())
        .groupBy("mid", "stretch", "kind", "member", "slide")
        .agg(F.sum("n").alias("n"))
        .groupBy("mid", "stretch", "kind", "member")
        .agg(F.collect_list(F.struct("slide", "n")).alias("slides"))
    )
    first = _floor_div(F.col("window_start"), window_ms)
    begins = _floor_div(F.pmod("window_start", F.lit(window_ms)), slide_ms)
    parts = F.array(
        F.struct(first.alias("stretch"), F.lit(True).alias("end")), F.struct((first + 1).alias("stretch"), F.lit(False).alias("end")),
    )
    windows = alerts.select("mid", "window_start", "window_end", begins.alias("begins"), F.inline(parts))
    inside = F.filter("slides", lambda s: (s["slide"] >= F.col("begins")) == F.col("end"))
    count = F.aggregate(inside, F.lit(0).cast("bigint"), lambda total, s: total + s["n"])
    return (
        windows.join(slides, ["mid", "stretch"])
        .select("mid", "window_start", "window_end", "kind", "member", count.alias("n"))
        .filter(F.col("n") > 0)
        .groupBy("mid", "window_start", "window_end", "kind", "member")
        .agg(F.sum("n").alias("n"))
    )


def as_documents(windows: DataFrame) -> DataFrame:
    """Name alerts by device and minute and file them under the day of their window end."""
    return windows.select(
        F.concat_ws("-", "mid", minute_of("window_end").cast("string")).alias("alert_id"),
        "mid",
        "uids",
        "itemIds",
        "events",
        F.col("window_end").alias("ts"),
        day_of("window_end").alias("dt"),
    )


def alert_documents(
    events: DataFrame, alerts: DataFrame, window_seconds: int = WINDOW_SECONDS, slide_seconds: int = SLIDE_SECONDS
) -> DataFrame:
    """The alert record: accounts, items, and how often each event occurred.

    ``events`` maps event ids to counts, which says as much as a list of the
    ids and stays small. ``listed_events`` turns it into the list.
    """
    of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("member"))))
    counts = F.array_sort(F.collect_list(F.when(F.col("kind") == "event", F.struct("member", "n"))))
    gathered = (
        alert_members(events, alerts, window_seconds, slide_seconds)
        .groupBy("mid", "window_start", "window_end")
        .agg(of("uid").alias("uids"), of("item").alias("itemIds"), F.map_from_entries(counts).alias("events"))
    )
    return as_documents(gathered)


def listed_events(documents: DataFrame) -> DataFrame:
    """``events`` as a list with one element per event, sorted by event id."""
    repeated = F.transform(
        F.array_sort(F.map_entries("events")), lambda e: F.array_repeat(e["key"], e["value"].cast("int"))
    )
    return documents.withColumn("events", F.flatten(repeated))


def counted_panes(events: DataFrame, slide_seconds: int = SLIDE_SECONDS) -> DataFrame:
    """Equal events of a pane as one row with their number ``n``; ``ts`` is the pane's start.

    No window edge cuts through a pane, so panes stand in for events in all
    functions here. ``events`` has its time in ``event_time``. The grouping
    is by whole events, so a busy device is spread over many groups.
    """
    pane = F.window("event_time", f"{slide_seconds} seconds").alias("pane")
    counts = events.groupBy("mid", "evid", "uid", "itemid", pane).agg(F.count("*").alias("n"))
    return counts.select("mid", "evid", "uid", "itemid", "n", F.unix_millis("pane.start").alias("ts"))
