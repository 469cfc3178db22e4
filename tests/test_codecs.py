"""Round trips and order of the key and value codecs."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from keyloom.functions import keycodecs as K
from keyloom.functions import valuecodecs as V

rng = random.Random(7)


def text(n=12):
    return "".join(chr(rng.choice([0, 1, 65, 97, 233, 8364, 128512, rng.randrange(32, 0xD7FF)])) for _ in range(rng.randrange(n)))


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_text_round_trip_and_order(spark):
    texts = sorted({text() for _ in range(100)})
    rows = frame(spark, [(t,) for t in texts], "s string").select("s", K.string_key.encode(F.col("s")).alias("b")).withColumn("t", K.string_key.decode(F.col("b"))).collect()
    assert all(r.s == r.t and bytes(r.b) == r.s.encode() for r in rows)
    assert [r.s for r in sorted(rows, key=lambda r: bytes(r.b))] == sorted(texts, key=lambda t: t.encode())


def test_uuid(spark):
    ids = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(100)]
    rows = frame(spark, [(i,) for i in ids], "s string").select("s", K.uuid_key.encode(F.col("s")).alias("b")).withColumn("t", K.uuid_key.decode(F.col("b"))).collect()
    assert all(r.s == r.t and bytes(r.b) == uuid.UUID(r.s).bytes for r in rows)
    assert sorted(ids) == [r.s for r in sorted(rows, key=lambda r: bytes(r.b))]


@pytest.mark.parametrize("codec", [K.uuid_key, K.ulid_key, K.location_key, K.instant_key, K.uuidv7_key])
def test_short_buffers(spark, codec):
    df = frame(spark, [(bytes(codec.width - 1),)], "b binary")
    assert df.select(codec.decode(F.col("b")).alias("v")).first().v is None
    with pytest.raises(Exception, match="insufficient_bytes"):
        df.select(codec.checked(F.col("b")).alias("v")).collect()


def test_pairs(spark):
    one, two = K.string_key, K.uuid_key
    rows = [(text(), text(), str(uuid.UUID(int=rng.getrandbits(120)))) for _ in range(150)]
    df = frame(spark, rows, "a string, b string, u string")
    for codec, b in ((K.pair_key(one, one), "b"), (K.pair_key(one, two), "u")):
        found = df.select(F.struct("a", F.col(b).alias("b")).alias("p")).withColumn("k", codec.encode(F.col("p"))).withColumn("q", codec.decode(F.col("k"))).collect()
        assert all(r.p == r.q for r in found)
        assert [r.p for r in sorted(found, key=lambda r: bytes(r.k))] == sorted((r.p for r in found), key=lambda p: (p.a.encode(), p.b.encode()))
        assert all(bytes(r.k).startswith(r.p.a.encode().replace(b"\0", b"\0\xff") + b"\0") for r in found)
    both = K.pair_key(two, two)
    assert both.width == 32 and K.pair_key(one, two).width is None and K.pair_key(two, one).width is None
    nested = K.pair_key(both, one)
    p = df.select(F.struct(F.struct(F.col("u").alias("a"), F.col("u").alias("b")).alias("a"), F.col("b")).alias("p"))
    assert all(r.p == r.q for r in p.withColumn("q", nested.decode(nested.encode(F.col("p")))).collect())


def test_pair_order_around_zero(spark):
    codec = K.pair_key(K.string_key, K.string_key)
    df = frame(spark, [("A", "z"), ("A\0", "a"), ("B", "a")], "a string, b string").select("a", codec.encode(F.struct("a", "b")).alias("k"))
    assert [r.a for r in sorted(df.collect(), key=lambda r: bytes(r.k))] == ["A", "A\0", "B"]


def test_pair_without_separator(spark):
    codec = K.pair_key(K.string_key, K.string_key)
    assert frame(spark, [(b"abc",), (b"a\0\xffb",)], "b binary").select(codec.decode(F.col("b")).alias("v")).where("v IS NOT NULL").count() == 0


def morton(lat, lon):
    y, x = int((lat + 90) / 180 * 4294967295), int((lon + 180) / 360 * 4294967295)
    return sum(((x >> i & 1) << 2 * i) | ((y >> i & 1) << 2 * i + 1) for i in range(32))


def test_locations(spark):
    points = [(-90.0, -180.0), (90.0, 180.0), (0.0, 0.0)] + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(200)]
    df = frame(spark, points, "lat double, lon double").withColumn("b", K.location_key.encode(F.struct("lat", "lon"))).withColumn("p", K.location_key.decode(F.col("b")))
    for r in df.withColumn("cell", K.location_cell(F.col("b"), 4)).collect():
        assert int.from_bytes(r.b, "big") == morton(r.lat, r.lon)
        assert abs(r.p.lat - r.lat) < 1e-7 and abs(r.p.lon - r.lon) < 1e-7
        assert bytes(r.cell) == bytes(r.b[:4]) + bytes(4)


def test_locations_beyond_the_axes_and_null(spark):
    points = [(-91.0, 181.0), (1e6, -1e6), (-0.0, 1e-12), (89.99999999, 179.99999999)] + [(rng.uniform(-400, 400), rng.uniform(-400, 400)) for _ in range(200)]
    for r in frame(spark, points, "lat double, lon double").withColumn("b", K.location_bytes(F.col("lat"), F.col("lon"))).collect():
        assert int.from_bytes(r.b, "big") == morton(r.lat, r.lon)
    nulls = frame(spark, [(None, 1.0), (1.0, None)], "lat double, lon double").withColumn("b", K.location_bytes(F.col("lat"), F.col("lon")))
    assert [r.b for r in nulls.collect()] == [None, None]
    codes = [0, (1 << 64) - 1, 1 << 63, 1, 2] + [rng.getrandbits(64) for _ in range(200)]
    for r in frame(spark, [(c.to_bytes(8, "big"),) for c in codes], "b binary").withColumn("p", K.bytes_location(F.col("b"))).collect():
        n = int.from_bytes(r.b, "big")
        y, x = (sum((n >> 2 * i + odd & 1) << i for i in range(32)) for odd in (1, 0))
        assert (r.p.lat, r.p.lon) == (y / 4294967295 * 180 - 90, x / 4294967295 * 360 - 180)


def test_location_is_not_evaluated_bit_by_bit(spark):
    """A fold over 32 bits that holds the code in its body encodes every point anew for each of them."""
    df = spark.range(1).select(F.rand().alias("lat"), F.rand().alias("lon"))
    coded = df.select(K.location_bytes(F.col("lat"), F.col("lon")).alias("b"))
    for plan in (coded, coded.select(K.bytes_location(F.col("b")).alias("p")), coded.groupBy(K.location_cell(F.col("b"), 2)).count()):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in text and "aggregate(" not in text
        assert text.count("conv(") <= 10


def test_instants(spark):
    secs = [-(1 << 62), -1, 0, 0, 1, 1_700_000_000, 1 << 62]
    rows = [(s, n) for s, n in zip(secs, [0, 999_999_999, 0, 1, 5, 123_456_789, 0])]
    df = frame(spark, rows, "sec long, nano int").withColumn("b", K.instant_key.encode(F.struct("sec", "nano"))).withColumn("i", K.instant_key.decode(F.col("b")))
    found = df.collect()
    assert all((r.i.sec, r.i.nano) == (r.sec, r.nano) and len(r.b) == 12 for r in found)
    assert [(r.sec, r.nano) for r in sorted(found, key=lambda r: bytes(r.b))] == sorted(rows)


def test_instants_from_timestamps(spark):
    times = [dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(1970, 1, 1), dt.datetime(2024, 2, 29, 1, 2, 3, 4)]
    df = frame(spark, [(t,) for t in times], "ts timestamp")
    back = K.instant_timestamp(K.instant_key.decode(K.instant_key.encode(K.instant(F.col("ts")))))
    assert df.where(back != F.col("ts")).count() == 0


def test_ulids(spark):
    values = [0, (1 << 128) - 1] + [rng.getrandbits(128) for _ in range(200)]
    df = frame(spark, [(v.to_bytes(16, "big"),) for v in values], "b binary").withColumn("u", K.ulid_key.decode(F.col("b"))).withColumn("c", K.ulid_key.encode(F.col("u")))
    for r in df.collect():
        n, want = int.from_bytes(r.b, "big"), ""
        for _ in range(26):
            want, n = K.CROCKFORD[n & 31] + want, n >> 5
        assert r.u == want and bytes(r.c) == bytes(r.b)


def test_uuidv7(spark):
    df = frame(spark, [(dt.datetime(2024, 5, 6, 7, 8, 9, 123456),)], "ts timestamp").select(K.uuidv7_of(F.col("ts")).alias("u"), K.uuidv7_now().alias("now"))
    r = df.first()
    u = uuid.UUID(r.u)
    assert u.version == 7 and u.variant == uuid.RFC_4122 and u.int >> 80 == 1714979289123
    assert uuid.UUID(r.now).version == 7
    assert df.select(K.uuidv7_millis(F.col("u")).alias("m"), K.uuidv7_version(F.col("u")).alias("v")).first() == (1714979289123, 7)


def test_collation(spark):
    words = ["côté", "cote", "côte", "coté", "zebra", "Zebra"]
    df = frame(spark, [(w,) for w in words], "w string")
    plain = [r.w for r in df.orderBy(K.collated(F.col("w"))).collect()]
    assert plain[:4] == ["cote", "coté", "côte", "côté"] and plain[4:] == ["zebra", "Zebra"]
    b = frame(spark, [(b"\x01\xff",)], "b binary")
    assert bytes(b.select(K.collation_from_base64(K.collation_to_base64(F.col("b"))).alias("b")).first().b) == b"\x01\xff"
    assert bytes(b.select(K.collation_key.decode(K.collation_key.encode(F.col("b"))).alias("b")).first().b) == b"\x01\xff"


def test_records(spark):
    df = frame(spark, [('{"name":"A","user":{"age":null}}',)], "s string")
    r = df.select(V.record_decode(F.col("s"), "name string, user struct<first:string,age:int>").alias("v")).first().v
    assert r.name == "A" and r.user.age is None
    with pytest.raises(Exception, match="MALFORMED"):
        frame(spark, [("{nope",)], "s string").select(V.record_decode(F.col("s"), "a int").alias("v")).collect()
    loose = frame(spark, [("{nope",)], "s string").select(V.record_decode(F.col("s"), "a int", strict=False).alias("v")).first().v
    assert loose is None or loose.a is None
    assert frame(spark, [(1, "x")], "a int, b string").select(V.record_encode(F.struct("a", "b")).alias("s")).first().s == '{"a":1,"b":"x"}'


def test_plain_values(spark):
    df = frame(spark, [('a "b" \n é',), ("",)], "s string").withColumn("j", V.text_encode(F.col("s"))).withColumn("t", V.text_decode(F.col("j")))
    assert all(r.s == r.t for r in df.collect())
    n = frame(spark, [("12",), ("-3.5e2",)], "s string")
    assert [r.v for r in n.select(V.number_decode(F.col("s"), "double").alias("v")).collect()] == [12.0, -350.0]
    assert n.limit(1).select(V.number_decode(F.col("s"), "int").alias("v")).first().v == 12
    with pytest.raises(Exception, match="OVERFLOW|out of range"):
        frame(spark, [("3000000000",)], "s string").select(V.number_decode(F.col("s"), "int").alias("v")).collect()
    assert frame(spark, [('{"a":[1]}',)], "s string").select(V.any_encode(V.any_decode(F.col("s"))).alias("v")).first().v == '{"a":[1]}'


def test_custom_codec(spark):
    enc, dec = V.custom(lambda s: s.map(lambda x: x[::-1].encode()), lambda b: b.map(lambda x: bytes(x).decode()[::-1]), "string")
    assert frame(spark, [("abc",)], "s string").select(dec(enc("s")).alias("s")).first().s == "abc"


def test_malformed_bytes_and_texts_raise(spark):
    from keyloom.functions import valuecodecs as V

    codec = K.pair_key(K.string_key, K.uuid_key)
    for bad in (b"abc", b"a\x00b\x00" + bytes(range(1, 17)), b"a\x00short"):
        with pytest.raises(Exception, match="missing_separator|unescaped_zero|insufficient_bytes"):
            spark.createDataFrame([(bytearray(bad),)], "b binary").select(codec.checked(F.col("b"))).collect()
    for bad in ("8" + "Z" * 25, "U" * 26, "0" * 25):
        with pytest.raises(Exception, match="ulid"):
            spark.createDataFrame([(bad,)], "s string").select(K.ulid_key.encode(F.col("s"))).collect()
    assert len(spark.createDataFrame([("7" + "z" * 25,)], "s string").select(K.ulid_key.encode(F.col("s")).alias("b")).first().b) == 16
    for bad in ("NaN", "1d", " 1 ", "01", ".5", "+1"):
        with pytest.raises(Exception, match="JSON number"):
            spark.createDataFrame([(bad,)], "s string").select(V.number_decode(F.col("s"), "double")).collect()
    assert spark.createDataFrame([("-1.5e3",)], "s string").select(V.number_decode(F.col("s"), "double").alias("n")).first().n == -1500.0
