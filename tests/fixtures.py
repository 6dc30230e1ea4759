"""Small hand-made tables with the cases the operators must get right."""

import datetime as dt
import random

TRIP_DDL = (
    "seq_id BIGINT, hubway_id BIGINT, status STRING, duration INT, start_date STRING, strt_statn INT, "
    "end_date STRING, end_statn INT, bike_nr STRING, subsc_type STRING, zip_code STRING, birth_date INT, gender STRING"
)
WEATHER_DDL = (
    "STATION STRING, STATION_NAME STRING, ELEVATION DOUBLE, LATITUDE DOUBLE, LONGITUDE DOUBLE, "
    "DATE STRING, HPCP DOUBLE, Measurement_Flag STRING, Quality_Flag STRING"
)
DAY0 = dt.datetime(2012, 3, 1)


def text(ts, padded=False):
    if padded:
        return ts.strftime("%m/%d/%Y %H:%M:%S")
    return f"{ts.month}/{ts.day}/{ts.year} {ts.hour}:{ts.minute:02d}:{ts.second:02d}"


def trip(seq, ts, station, seconds, kind="Registered", end=5, padded=False):
    member = kind == "Registered"
    return (
        seq, seq + 100, "closed", seconds, text(ts, padded), station, text(ts, padded), end, "B1", kind,
        "'02134" if member else None, 1980 if member else None, "Female" if member else None,
    )


def station_trips():
    """Stations with 5, 7, 8 and 30 active days; station 30 has a gap of 100 days."""
    rng, rows = random.Random(7), []
    for station, days in ((5, 5), (7, 7), (8, 8), (30, 30)):
        for day in range(days):
            shift = 100 if station == 30 and day >= 15 else 0
            for _ in range(rng.randint(1, 6)):
                ts = DAY0 + dt.timedelta(days=day + shift, minutes=rng.randint(0, 1439), seconds=rng.randint(0, 59))
                rows.append(trip(len(rows), ts, station, rng.randint(30, 8000), padded=len(rows) % 2 == 0))
    return rows


def edge_trips():
    at = lambda day, hour, minute=0: DAY0 + dt.timedelta(days=day, hours=hour, minutes=minute)
    return [
        trip(1000, at(0, 12, 0), 1, 600),
        trip(1001, at(0, 12, 1), 1, 5400),  # exactly 90 minutes
        trip(1002, at(0, 0, 0), 1, 5401, "Casual"),  # the previous day's 23:00 reading; above the cap
        trip(1003, at(1, 9), 1, None),
        trip(1004, at(1, 9), 1, -60),
        trip(1005, at(1, 9), None, 600),
        trip(1006, at(2, 9), 1, 100000),  # the only trip of the day is above the cap
        trip(1007, at(3, 9), 1, 600, end=None),
    ]


def reading(ts, rain, flag=None):
    return ("COOP:1", "MAIN", 6.1, 42.3, -71.0, ts.strftime("%Y%m%d %H:%M"), rain, flag, None)
