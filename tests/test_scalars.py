import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetloom.functions import scalars as S


@pytest.fixture(scope="module")
def one(spark):
    def value(column, **given):
        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()] or ["id"])
        return df.select(column.alias("x")).first()["x"]

    return value


def test_rate(one):
    assert one(S.rate(F.lit(10), F.lit(130), F.lit(60))) == 2.0
    assert one(S.rate(F.lit(10), F.lit(0), F.lit(0))) is None
    assert one(S.ratio(F.lit(1), F.lit(3))) == 0.33


def test_times(one):
    at = F.lit("2019-02-14 09:59:01").cast("timestamp")
    assert one(S.compact_time(at)) == "20190214095901"
    assert one(S.compact_date(at)) == "20190214"
    assert one(S.second_of_day(at)) == 9 * 3600 + 59 * 60 + 1
    assert one(S.clock_to_second(F.lit("01:00:01"))) == 3601
    assert one(S.from_epoch(S.to_epoch(at)).cast("string")) == "2019-02-14 09:59:01"
    assert one(S.minus_minutes(at, 60).cast("string")) == "2019-02-14 08:59:01"
    assert one(S.minute_of(at).cast("string")) == "2019-02-14 09:59:00"
    assert one(S.plus_months(F.lit(dt.date(2019, 1, 31)), 1)) == dt.date(2019, 2, 28)


@pytest.mark.parametrize("day,number", [("2019-02-17", 0), ("2019-02-18", 1), ("2019-02-23", 6)])
def test_weekday_number(one, day, number):
    assert one(S.weekday_number(F.lit(day).cast("date"))) == number


@pytest.mark.parametrize("day,wednesday", [("2019-02-17", "2019-02-20"), ("2019-02-18", "2019-02-27"), ("2019-02-23", "2019-02-27")])
def test_day_in_week(one, day, wednesday):
    assert str(one(S.day_in_week(F.lit(day).cast("date"), 3))) == wednesday


@pytest.mark.parametrize("text,want", [
    ("2019-02-14 09:59:01", "2019-02-14 09:59:01"), ("2019-02-14", "2019-02-14 00:00:00"), ("1970-01-01 00:00:00", None), ("", None), ("soon", None),
])
def test_lenient_time(one, text, want):
    assert one(S.lenient_time(F.lit(text)).cast("string")) == want


def test_dates_and_numbers(one):
    assert one(S.is_date(F.lit("20190214"))) is True and one(S.is_date(F.lit("20190230"))) is False
    assert one(S.is_number(F.lit("0"))) is True and one(S.is_number(F.lit("x1"))) is False
    assert one(S.percent_to_number(F.lit("85%"))) == 85.0 and one(S.percent_to_number(F.lit("full"))) is None
    assert one(S.bounded_number(F.lit(25), 10, 19)) == 15
    assert 3 <= one(S.spread_number(F.lit("host"), 3, 5)) <= 5
    assert one(S.lenient_epoch(F.lit("never"))) == 0


def test_names(one):
    assert one(S.name_part(F.lit("shop.orders"), 2)) == "orders" and one(S.name_part(F.lit("shop"), 2)) is None
    assert one(S.flatten_name(F.lit("`Shop`.'T'"))) == "shop_t"
    assert one(S.drop_auto_increment(F.lit("ENGINE=InnoDB AUTO_INCREMENT=12 DEFAULT"))) == "ENGINE=InnoDB DEFAULT"
    assert one(S.instance_task_id(F.lit("10.0.0.1"), F.lit(3306), F.lit("2019-02-14 09:59:01").cast("timestamp"))) == "10001_3306_20190214095901"
    assert one(S.run_task_id(F.lit("shop"), F.lit(dt.date(2019, 2, 14)), F.lit("xtrabackup"))) == "SHOP-20190214-XTRABACKUP"
    assert one(S.fill_template(F.lit("a_#yyyy#_db.t_#mmdd#"), F.lit(dt.date(2019, 2, 4)))) == "a_2019_db.t_0204"
    assert one(S.map_chars(F.lit("a-b c"), "-ab", "_A")) == "A_ c"
    assert one(S.match_start(F.lit("abc12"), "[0-9]+")) == 4
    assert one(S.normalise_punctuation(F.lit("是，（好）！"))) == "是,(好)!"


def test_dict_text(one):
    raw = "{u'master_log_pos': 7654321L, 'master_host': u'10.0.0.2', u'master_port': u'10000', u'master_gtid': ''}"
    got = one(S.dict_text_to_struct(F.lit(raw), "master_host string, master_port string, master_log_pos long, master_gtid string"))
    assert tuple(got) == ("10.0.0.2", "10000", 7654321, "")
    # A value that ends in u, and one that looks like a long mark, stay as they are.
    got = one(S.dict_text_to_struct(F.lit("{u'a': u'menu', 'b': 'x: 5L'}"), "a string, b string"))
    assert got["a"] == "menu"


def test_ranges_and_json(one):
    assert tuple(one(S.range_text(F.lit("00:00:01-01:00:01")))) == (1, 3601)
    assert one(S.rule_array(F.lit("0-7-365-3650"))) == [0, 7, 365, 3650]
    assert one(S.to_sorted_json({"b": F.lit(1), "a": F.lit("x")})) == '{"a":"x","b":1}'
    assert one(S.text_bytes(F.lit("é"))) == 2 and one(S.text_length(F.lit("é"))) == 1


def test_lists_hosts_and_zones(one):
    assert one(S.comma_list(F.lit("mail, sms,,phone "))) == ["mail", "sms", "phone"]
    assert tuple(one(S.host_port(F.lit("10.0.0.12:10000")))) == ("10.0.0.12", 10000)
    assert one(S.wall_clock(F.lit("2019-02-14 06:41:24").cast("timestamp"), "Asia/Shanghai").cast("string")) == "2019-02-14 14:41:24"
