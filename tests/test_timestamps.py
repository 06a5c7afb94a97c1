from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from acervo.operators.timestamps import offset_intervals, with_normal_form

SP, NY = "America/Sao_Paulo", "America/New_York"
CASES = [
    ("21/09/2018", SP, "2018-09-21"),
    ("02/04/16", SP, "2016-04-02"),
    ("11.8.2017", SP, "2017-08-11"),
    ("aos 25 dias do mês de janeiro de 2025", SP, "2025-01-25"),
    ("1º de Outubro de 2022", SP, "2022-10-01"),
    ("04/VI/2013", SP, "2013-06-04"),
    ("23-AGO-10", SP, "2010-08-23"),
    ("June 6, 2016", SP, "2016-06-06"),
    ("MAIO/2024", SP, "2024-05"),
    ("09/2010", SP, "2010-09"),
    ("2024-10", SP, "2024-10"),
    ("20221127", SP, "2022-11-27"),
    ("1405580413853", SP, "2014-07-17T07:00:13.853Z"),
    ("14:36 de 18/1/2023", SP, "2023-01-18T17:36:00.000Z"),
    ("October 15, 2016 11:08 PM", "America/Manaus", "2016-10-16T03:08:00.000Z"),
    ("03/05/2024 às 05:33 (horário de Brasília)", "Europe/Lisbon", "2024-05-03T08:33:00.000Z"),
    ("2024-12-07 15:49:58 America/Manaus", SP, "2024-12-07T19:49:58.000Z"),
    ("2011-09-12T21:03:58,213999-03:00", SP, "2011-09-13T00:03:58.213Z"),
    ("15/10/2011 21:46:42 UTC-3", NY, "2011-10-16T00:46:42.000Z"),
    ("21/01/2023 12:13:20 WEST", SP, "2023-01-21T11:13:20.000Z"),
    ("2015-10-18 00:23:10", SP, "2015-10-18T03:23:10.000Z"),  # skipped hour: the offset before the change
    ("November 4, 2018 1:30 AM", NY, "2018-11-04T05:30:00.000Z"),  # repeated hour: its first occurrence
    ("2012-13-24", SP, None),
    ("31/02/2021", SP, None),
    ("21/09/2018 25:10", SP, None),
    ("data a definir", SP, None),
    ("__/__/2022", SP, None),
    ("", SP, None),
    (None, SP, None),
    ("x" * 100_000, SP, None),
    ("2015-10-18 10:23:10", None, None),
    ("2015-10-18 10:23:10", "Mars/Base", None),
    ("2015-10-18", None, "2015-10-18"),
]


def test_notations(spark):
    rows = [(i, t, z, "kept") for i, (t, z, _) in enumerate(CASES)] * 2
    df = spark.createDataFrame(rows, "id int, text string, zone string, zone_name string")
    got = with_normal_form(df, "text", "zone").collect()
    assert len(got) == 2 * len(CASES)
    for r in got:
        assert r.normal_form == CASES[r.id][2], CASES[r.id]
        assert r.zone_name == "kept"


def test_empty_table_and_replaced_column(spark):
    df = spark.createDataFrame([], "text string, zone string, normal_form string")
    assert with_normal_form(df, "text", "zone").columns == ["text", "zone", "normal_form"]
    assert with_normal_form(df, "text", "zone").count() == 0


@pytest.mark.parametrize("zone", [SP, NY, "Europe/Lisbon", "Asia/Kathmandu", "UTC"])
def test_intervals_agree_with_the_zone_database(zone):
    tz = ZoneInfo(zone)
    spans = offset_intervals(zone)
    for day in range(0, 60 * 365, 11):
        at = datetime(1975, 1, 1, 5, 17, tzinfo=timezone.utc) + timedelta(days=day)
        offset = int(at.astimezone(tz).utcoffset().total_seconds())
        local = int(at.timestamp()) + offset
        assert offset in [o for a, b, o in spans if a <= local < b]
