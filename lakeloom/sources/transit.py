"""A warehouse of a transit agency: taps on card readers become trips, prices and reports. Statements in all shapes that the parser
must understand, each with every edge it stands for."""

from dataclasses import dataclass, field


def table(columns: str) -> dict[str, str]:
    return dict(c.split() for c in columns.split(";"))


SCHEMA = {
    "feed": {
        "taps": table("card string;stop string;line string;tapped_at timestamp;kind string;day string"),
        "stops": table("stop string;zone string;name string"),
        "lines": table("line string;operator string;modes string"),
        "fares": table("zone_from string;zone_to string;cents int"),
    },
    "tmp_trips": {"legs": table("card string;line string;stop string;next_stop string;seconds bigint"), "priced": table("card string;line string;zone string;cents int")},
    "core": {
        "trips": table("card string;line string;stop string;next_stop string;minutes int;day string"),
        "trip_prices": table("card string;line string;cents int;day string"),
        "taps_kept": table("card string;stop string;line string;tapped_at timestamp;kind string;day string"),
    },
    "mart": {
        "line_day": table("line string;operator string;trips bigint;minutes bigint;day string"),
        "card_total": table("card string;cents bigint;trips bigint"),
        "zone_cube": table("zone string;line string;taps bigint;day string"),
    },
    "show": {"ranking": table("line string;place int"), "line_modes": table("line string;mode string"), "notes": table("card string;note string")},
}


@dataclass
class Case:
    sql: str
    target: str | None = None
    sources: str = ""
    columns: dict[str, str] = field(default_factory=dict)  # target column: leaves, with a space between
    status: str = "success"
    reason: str = ""


CASES = {
    # rows numbered within a card; the pair of a tap is found by lead()
    "legs": Case(
        """WITH paired AS (SELECT card, line, stop, lead(stop) OVER (PARTITION BY card ORDER BY tapped_at) AS following, tapped_at,
             lead(tapped_at) OVER (PARTITION BY card ORDER BY tapped_at) AS left_at, kind FROM feed.taps)
           INSERT OVERWRITE TABLE tmp_trips.legs SELECT card, line, stop, following, unix_timestamp(left_at) - unix_timestamp(tapped_at) FROM paired WHERE kind = 'in'""",
        "tmp_trips.legs", "feed.taps",
        {"card": "feed.taps.card", "line": "feed.taps.line", "stop": "feed.taps.stop", "next_stop": "feed.taps.stop feed.taps.card feed.taps.tapped_at", "seconds": "feed.taps.tapped_at feed.taps.card"},
    ),
    # a static partition: five of six columns are selected
    "trips": Case(
        "INSERT OVERWRITE TABLE core.trips PARTITION (day = '2030-01-02') SELECT card, line, stop, next_stop, CAST(seconds / 60 AS int) FROM tmp_trips.legs WHERE next_stop IS NOT NULL",
        "core.trips", "tmp_trips.legs",
        {"card": "tmp_trips.legs.card", "line": "tmp_trips.legs.line", "stop": "tmp_trips.legs.stop", "next_stop": "tmp_trips.legs.next_stop", "minutes": "tmp_trips.legs.seconds"},
    ),
    # three joins, one side twice
    "priced": Case(
        """INSERT INTO tmp_trips.priced SELECT t.card, t.line, a.zone, f.cents FROM core.trips t JOIN feed.stops a ON t.stop = a.stop
           JOIN feed.stops b ON t.next_stop = b.stop LEFT JOIN feed.fares f ON f.zone_from = a.zone AND f.zone_to = b.zone""",
        "tmp_trips.priced", "core.trips feed.fares feed.stops",
        {"card": "core.trips.card", "line": "core.trips.line", "zone": "feed.stops.zone", "cents": "feed.fares.cents"},
    ),
    # a column list in an order of its own
    "prices": Case(
        "INSERT INTO core.trip_prices (cents, card, line) SELECT coalesce(cents, 0), card, line FROM tmp_trips.priced",
        "core.trip_prices", "tmp_trips.priced",
        {"cents": "tmp_trips.priced.cents", "card": "tmp_trips.priced.card", "line": "tmp_trips.priced.line"},
    ),
    # hint, aggregates, a constant and DISTRIBUTE BY
    "line_day": Case(
        """INSERT OVERWRITE TABLE mart.line_day SELECT /*+ BROADCAST(l) */ t.line, l.operator, count(1), sum(t.minutes), '2030-01-02'
           FROM core.trips t JOIN feed.lines l ON t.line = l.line WHERE t.day = '2030-01-02' GROUP BY t.line, l.operator DISTRIBUTE BY t.line""",
        "mart.line_day", "core.trips feed.lines",
        {"line": "core.trips.line", "operator": "feed.lines.operator", "minutes": "core.trips.minutes"},
    ),
    # yesterday's totals and today's prices: the table is its own source, branches map by position
    "card_total": Case(
        """INSERT OVERWRITE TABLE mart.card_total SELECT card, sum(cents), sum(trips) FROM (
             SELECT card, cents, trips FROM mart.card_total UNION ALL SELECT card, CAST(cents AS bigint), 1 FROM core.trip_prices) both GROUP BY card""",
        "mart.card_total", "core.trip_prices mart.card_total",
        {"card": "core.trip_prices.card mart.card_total.card", "cents": "core.trip_prices.cents mart.card_total.cents", "trips": "mart.card_total.trips"},
    ),
    "cube": Case(
        """INSERT OVERWRITE TABLE mart.zone_cube PARTITION (day = '2030-01-02') SELECT s.zone, t.line, count(*) FROM feed.taps t JOIN feed.stops s USING (stop)
           GROUP BY s.zone, t.line GROUPING SETS ((s.zone, t.line), (s.zone), ())""",
        "mart.zone_cube", "feed.stops feed.taps", {"zone": "feed.stops.zone", "line": "feed.taps.line"},
    ),
    "ranking": Case("INSERT OVERWRITE TABLE show.ranking SELECT line, rank() OVER (ORDER BY trips DESC) FROM mart.line_day", "show.ranking", "mart.line_day", {"line": "mart.line_day.line", "place": "mart.line_day.trips"}),
    "line_modes": Case("INSERT OVERWRITE TABLE show.line_modes SELECT line, m FROM feed.lines LATERAL VIEW explode(split(modes, '/')) x AS m", "show.line_modes", "feed.lines", {"line": "feed.lines.line", "mode": "feed.lines.modes"}),
    "kept": Case("INSERT OVERWRITE TABLE core.taps_kept SELECT * FROM feed.taps", "core.taps_kept", "feed.taps", {c: f"feed.taps.{c}" for c in SCHEMA["feed"]["taps"]}),
    # subqueries in the list and in the condition; only the one in the list makes values
    "notes": Case(
        "INSERT INTO show.notes SELECT card, (SELECT max(name) FROM feed.stops) FROM mart.card_total c WHERE EXISTS (SELECT 1 FROM core.trips t WHERE t.card = c.card)",
        "show.notes", "core.trips feed.stops mart.card_total", {"card": "mart.card_total.card", "note": "feed.stops.name"},
    ),
    "view": Case("CREATE VIEW show.cheap AS SELECT card, cents AS spent FROM mart.card_total WHERE cents < 500", "show.cheap", "mart.card_total", {"card": "mart.card_total.card", "spent": "mart.card_total.cents"}),
    "made": Case("CREATE TABLE show.operators AS SELECT DISTINCT operator, upper(modes) AS m FROM feed.lines", "show.operators", "feed.lines", {"operator": "feed.lines.operator", "m": "feed.lines.modes"}),
    # one common table expression over another, the first used twice
    "nested": Case(
        """INSERT OVERWRITE TABLE show.ranking WITH d AS (SELECT line, minutes FROM mart.line_day), m AS (SELECT max(minutes) AS most FROM d)
           SELECT d.line, CASE WHEN d.minutes = m.most THEN 1 ELSE 2 END FROM d CROSS JOIN m""",
        "show.ranking", "mart.line_day", {"line": "mart.line_day.line", "place": "mart.line_day.minutes"},
    ),
    "two_targets": Case("FROM feed.taps INSERT OVERWRITE TABLE core.taps_kept SELECT * INSERT INTO show.notes SELECT card, kind", status="failed", reason="multi_insert_unsupported"),
    "constants": Case("INSERT INTO show.notes VALUES ('c', 'n')", "show.notes", status="degraded", reason="no_select"),
    "unknown_table": Case("INSERT OVERWRITE TABLE core.taps_kept SELECT * FROM feed.refunds", "core.taps_kept", "feed.refunds", status="degraded", reason="star_unresolved"),
    "unknown_column": Case("INSERT OVERWRITE TABLE core.taps_kept SELECT colour FROM feed.taps", "core.taps_kept", "feed.taps", status="degraded", reason="qualify_failed"),
    "no_target": Case("SELECT card FROM feed.taps", status="failed", reason="no_target"),
    "broken": Case("INSERT OVERWRITE TABLE show.notes SELEKT card FROM", status="failed", reason="parse_error"),
}
STATUSES: dict[str, int] = {}
for _case in CASES.values():
    STATUSES[_case.status] = STATUSES.get(_case.status, 0) + 1
