"""Order-preserving key encodings as column expressions.

Every codec has ``encode(column) -> binary`` whose unsigned byte order is the
value's order (for locations: Z-order), ``decode(binary) -> column`` and a
``width`` in bytes, None if it varies.  All run in the JVM.  Decoding a buffer
that is too short gives null; ``checked`` makes it an error instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.errors import KeyCodecError

CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


@dataclass(frozen=True)
class KeyCodec:
    name: str
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]
    width: int | None
    strict: Callable[[Column], Column] | None = None

    def checked(self, buffer: Column) -> Column:
        """Decode, raising at run time where the buffer holds fewer bytes than the codec's width or is malformed."""
        if self.strict is not None:
            return self.strict(buffer)
        if self.width is None:
            return self.decode(buffer)
        short = F.octet_length(buffer) < self.width
        return F.when(short, F.raise_error(F.lit(str(KeyCodecError("insufficient_bytes", self.name))))).otherwise(self.decode(buffer))


def _error(kind: str, name: str) -> Column:
    return F.raise_error(F.lit(str(KeyCodecError(kind, name))))


def _fixed(width: int, decode: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda b: F.when(F.octet_length(b) >= width, decode(b))


def hex_long(value: Column) -> Column:
    """A bigint as 16 hex digits, big-endian."""
    return F.lpad(F.hex(value.cast("bigint")), 16, "0")


def unhex_long(digits: Column) -> Column:
    """Sixteen hex digits as a bigint, two's complement."""
    high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digits, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


# Text.
string_key = KeyCodec("string", lambda s: F.encode(s, "UTF-8"), lambda b: F.decode(b, "UTF-8"), None)


# UUIDs: canonical text orders like its bytes.
def uuid_to_bytes(text: Column) -> Column:
    return F.unhex(F.replace(text, F.lit("-"), F.lit("")))


def bytes_to_uuid(b: Column) -> Column:
    h = F.lower(F.hex(F.substring(b, 1, 16)))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


uuid_key = KeyCodec("uuid", uuid_to_bytes, _fixed(16, bytes_to_uuid), 16)


# Pairs.
def escape(b: Column) -> Column:
    """Every zero byte becomes 00 FF, so that a plain 00 can end the part."""
    return F.unhex(F.regexp_replace(F.hex(b), r"\G((?:(?!00)..)*)00", "$100FF"))


def unescape(b: Column) -> Column:
    return F.unhex(F.regexp_replace(F.hex(b), r"\G((?:(?!00FF)..)*)00FF", "$100"))


def pair_key(first: KeyCodec, second: KeyCodec) -> KeyCodec:
    """Codec of structs (a, b): ordered by a, then by b.

    A first part of fixed width stands as it is; one of varying width has its
    zero bytes escaped and a zero byte behind it.  The second part must then
    not begin with FF, which would read as an escape: text never does, but a
    UUID or location may.  A struct of two columns is the key to prefer, the
    bytes are for exchange.
    """

    def encode(pair: Column) -> Column:
        a, b = first.encode(pair["a"]), second.encode(pair["b"])
        return F.concat(a, b) if first.width is not None else F.concat(escape(a), F.unhex(F.lit("00")), b)

    def decode(buffer: Column) -> Column:
        h = F.hex(buffer)
        if first.width is not None:
            a, rest = F.substring(buffer, 1, first.width), F.unhex(F.substring(h, 2 * first.width + 1, 1 << 30))
        else:
            head = F.regexp_extract(h, r"^((?:(?!00)..|00FF)*)00(?!FF)", 1)
            a, rest = unescape(F.unhex(head)), F.unhex(F.substring(h, F.length(head) + 3, F.length(h)))
        found = F.struct(first.decode(a).alias("a"), second.decode(rest).alias("b"))
        return found if first.width is not None else F.when(h.rlike(r"^(?:(?!00)..|00FF)*00(?!FF)"), found)

    def strict(buffer: Column) -> Column:
        """Without a zero byte that ends the first part, or with one too many in it, the bytes are no pair."""
        h, found = F.hex(buffer), decode(buffer)
        out = F.when(~h.rlike(r"^(?:(?!00)..|00FF)*00(?!FF)"), _error("missing_separator", name))
        if second.width is not None:
            rest = (F.length(h) - F.length(F.regexp_extract(h, r"^((?:(?!00)..|00FF)*)00(?!FF)", 1)) - 2) / 2
            out = out.when(rest > second.width, _error("unescaped_zero", name)).when(rest < second.width, _error("insufficient_bytes", name))
        return out.otherwise(found)

    name = f"({first.name}, {second.name})"
    width = first.width + second.width if first.width is not None and second.width is not None else None
    return KeyCodec(name, encode, decode, width, strict if first.width is None else None)


# Locations: the bits of both axes interleaved, longitude's in the even places.
_SCALE = float((1 << 32) - 1)


def _axis(value: Column, low: float, span: float) -> Column:
    return ((value - F.lit(low)) / F.lit(span) * F.lit(_SCALE)).cast("bigint")


def _spread(v: Column) -> Column:
    """The low 32 bits of a bigint in the even places: its binary digits, read in base four."""
    return F.conv(F.bin(v.bitwiseAND(F.lit((1 << 32) - 1))), 4, 10).cast("bigint")


def _gather(code: Column) -> Column:
    """The bits in the even places of a bigint, side by side."""
    return F.conv(F.conv(F.hex(code.bitwiseAND(F.lit(0x5555555555555555))), 16, 4), 2, 10).cast("bigint")


def location_code(lat: Column, lon: Column) -> Column:
    """Z-order code of a point as a bigint; compare it as bytes or unsigned.

    Each axis stands in the expression once: a fold over the bits would evaluate it anew for every bit.
    """
    y, x = _axis(lat, -90.0, 180.0), _axis(lon, -180.0, 360.0)
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def location_bytes(lat: Column, lon: Column) -> Column:
    return F.unhex(hex_long(location_code(lat, lon)))


def bytes_location(b: Column) -> Column:
    """struct(lat, lon), off by less than a ten-millionth of a degree."""
    code = unhex_long(F.hex(F.substring(b, 1, 8)))
    lat = _gather(F.shiftrightunsigned(code, 1)).cast("double") / F.lit(_SCALE) * F.lit(180.0) - F.lit(90.0)
    lon = _gather(code).cast("double") / F.lit(_SCALE) * F.lit(360.0) - F.lit(180.0)
    return F.struct(lat.alias("lat"), lon.alias("lon"))


location_key = KeyCodec("location", lambda p: location_bytes(p["lat"], p["lon"]), _fixed(8, bytes_location), 8)


def location_cell(b: Column, n: int) -> Column:
    """The cell of the first ``n`` bytes, zeros behind: the cell's lower corner."""
    return F.concat(F.substring(b, 1, n), F.unhex(F.lit("00" * (8 - n))))


# Instants: struct(sec bigint, nano int).
def instant(ts: Column) -> Column:
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.struct(F.floor(micros / F.lit(1_000_000)).cast("bigint").alias("sec"), (F.pmod(micros, F.lit(1_000_000)) * 1000).cast("int").alias("nano"))


def instant_timestamp(i: Column) -> Column:
    """As a timestamp, which holds microseconds only."""
    return F.timestamp_micros(i["sec"] * 1_000_000 + F.floor(i["nano"] / 1000).cast("bigint"))


def _instant_bytes(i: Column) -> Column:
    sec = hex_long(i["sec"].bitwiseXOR(F.lit(-(1 << 63))))
    return F.unhex(F.concat(sec, F.lpad(F.hex(i["nano"].cast("bigint")), 8, "0")))


def _bytes_instant(b: Column) -> Column:
    h = F.hex(b)
    sec = unhex_long(F.substring(h, 1, 16)).bitwiseXOR(F.lit(-(1 << 63)))
    return F.struct(sec.alias("sec"), F.conv(F.substring(h, 17, 8), 16, 10).cast("int").alias("nano"))


instant_key = KeyCodec("instant", _instant_bytes, _fixed(12, _bytes_instant), 12)


# Collation: order by a locale's rules.  Spark compares by them but gives no sort-key bytes.
def collated(text: Column, locale: str = "UNICODE") -> Column:
    return F.collate(text, locale)


def collation_to_base64(key: Column) -> Column:
    return F.base64(key)


def collation_from_base64(text: Column) -> Column:
    return F.unbase64(text)


collation_key = KeyCodec("collation", lambda b: b, lambda b: b, None)


# ULIDs: 26 Crockford digits, 16 bytes.
def ulid_to_bytes(text: Column) -> Column:
    """The bytes of a ULID's text in either case; text that is none, or beyond 128 bits, raises."""
    good = F.upper(text).rlike(f"^[0-7][{CROCKFORD}]{{25}}$")
    return F.when(~good, _error("invalid_input", "ulid")).otherwise(_ulid_bytes(text))


def _ulid_bytes(text: Column) -> Column:
    t = F.translate(F.upper(text), CROCKFORD, BASE32)
    part = lambda at, n, digits: F.lpad(F.conv(F.substring(t, at, n), 32, 16), digits, "0")
    return F.unhex(F.concat(part(1, 2, 2), part(3, 12, 15), part(15, 12, 15)))


def bytes_to_ulid(b: Column) -> Column:
    h = F.hex(F.substring(b, 1, 16))
    part = lambda at, n, digits: F.lpad(F.conv(F.substring(h, at, n), 16, 32), digits, "0")
    return F.translate(F.concat(part(1, 2, 2), part(3, 15, 12), part(18, 15, 12)), BASE32, CROCKFORD)


ulid_key = KeyCodec("ulid", ulid_to_bytes, _fixed(16, bytes_to_ulid), 16)


# UUIDs of version 7: the first 48 bits are milliseconds.
def uuidv7_of(ts: Column, random_hex: Column | None = None) -> Column:
    """A version 7 UUID of an instant; ``random_hex``, 20 digits or more, replaces the random part."""
    r = F.lower(random_hex) if random_hex is not None else F.replace(F.uuid(), F.lit("-"), F.lit(""))
    ms = F.lower(F.lpad(F.hex(F.unix_millis(ts.cast("timestamp"))), 12, "0"))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(r, 4, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(r, 1, 3), F.lit("-"), variant, F.substring(r, 5, 3), F.lit("-"), F.substring(r, 8, 12))


def uuidv7_now() -> Column:
    return uuidv7_of(F.current_timestamp())


def uuidv7_millis(text: Column) -> Column:
    return F.conv(F.substring(F.replace(text, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("bigint")


def uuidv7_version(text: Column) -> Column:
    return F.conv(F.substring(text, 15, 1), 16, 10).cast("int")


uuidv7_key = KeyCodec("uuidv7", uuid_to_bytes, _fixed(16, bytes_to_uuid), 16)
