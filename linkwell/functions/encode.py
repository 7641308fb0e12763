"""Column functions from tokens to features, bits, chunks and projections.

A bit vector is the sorted array of its set positions (``array<bigint>``).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkwell.config import DEFAULT, LinkageConfig
from linkwell.functions.normalize import normalize, sorted_unique, tail_tokens, tokenize
from linkwell.functions.words64 import let

ALPHABET = "^$ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: Fixed values of the 64-bit string hash that published distances were made with.
MURMUR_SEED, MURMUR_M, MURMUR_SHIFT = 0xC70F6907, 0xC6A4A7935BD1E995, 47


def murmur64(gram: str) -> int:
    """MurmurHash64A of fewer than eight bytes."""
    data, mask = gram.encode(), (1 << 64) - 1
    h = MURMUR_SEED ^ (len(data) * MURMUR_M & mask)
    if data:
        h = (h ^ int.from_bytes(data, "little")) * MURMUR_M & mask
    h = (h ^ h >> MURMUR_SHIFT) * MURMUR_M & mask
    return h ^ h >> MURMUR_SHIFT


def hash_unit(*parts: object) -> Column:
    """A number from 0 to 2^32 - 1 by md5 of the parts: the same in any engine and run."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_unit_of(*parts: object) -> int:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def bit_of(gram: Column, config: LinkageConfig = DEFAULT, kind: str = "md5") -> Column:
    if kind == "md5":
        return F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("long") % config.bits
    if kind != "murmur" or config.gram_size != 2:
        raise ValueError("the kinds are md5, and murmur for bigrams")
    table = F.array(*[F.lit(murmur64(a + b) % config.bits) for a in ALPHABET for b in ALPHABET]).cast("array<bigint>")
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(gram, i, 1))
    return F.element_at(table, ((at(1) - 1) * len(ALPHABET) + at(2)).cast("int"))


def pad(token: Column, config: LinkageConfig = DEFAULT) -> Column:
    return F.concat(F.lit("^"), token, F.lit("$")) if config.boundary_grams else token


def qgrams(source: Column, size: int = 2) -> Column:
    """All windows of ``size`` characters; none of a shorter text."""
    starts = F.sequence(F.lit(1), F.length(source) - (size - 1))
    windows = F.transform(starts, lambda i: F.substring(source, i, F.lit(size)))
    return F.when(F.length(source) >= size, windows).otherwise(F.array().cast("array<string>"))


def canonical(gram: Column, config: LinkageConfig = DEFAULT) -> Column:
    """Inner bigrams in the order of their characters."""
    if not config.canonical_bigrams or config.gram_size != 2:
        return gram
    inner = ~gram.contains("^") & ~gram.contains("$")
    return F.when(inner & (F.substring(gram, 2, 1) < F.substring(gram, 1, 1)), F.reverse(gram)).otherwise(gram)


def token_grams(token: Column, config: LinkageConfig = DEFAULT) -> Column:
    grams = F.transform(qgrams(pad(token, config), config.gram_size), lambda g: canonical(g, config))
    return F.when(token == "", F.array().cast("array<string>")).otherwise(grams)


def encode_tokens(tokens: Column, config: LinkageConfig = DEFAULT, kind: str = "md5") -> Column:
    """The union of the tokens' bits. Without boundary grams: the grams of the sorted tokens joined."""
    if config.boundary_grams:
        grams = F.flatten(F.transform(F.array_distinct(tokens), lambda t: token_grams(t, config)))
    else:
        joined = F.array_join(F.array_sort(tokens), "")
        grams = F.transform(qgrams(joined, config.gram_size), lambda g: canonical(g, config))
    return F.array_sort(F.array_distinct(F.transform(grams, lambda g: bit_of(g, config, kind))))


def encode_base(name: Column, config: LinkageConfig = DEFAULT, kind: str = "md5") -> Column:
    return encode_tokens(tokenize(normalize(name)), config, kind)


def encode_tail_token(name: Column, config: LinkageConfig = DEFAULT, kind: str = "md5") -> Column:
    tokens = sorted_unique(tail_tokens(tokenize(normalize(name, keep_hyphen=True))))
    grams = F.flatten(F.transform(tokens, lambda t: token_grams(t, config)))
    return F.array_sort(F.array_distinct(F.transform(grams, lambda g: bit_of(g, config, kind))))


def encode_token_or(name: Column, config: LinkageConfig = DEFAULT, kind: str = "md5") -> Column:
    """Every token on its own, the vectors united."""
    each = F.transform(tokenize(normalize(name)), lambda t: F.transform(token_grams(t, config), lambda g: bit_of(g, config, kind)))
    if not config.boundary_grams:
        each = F.transform(tokenize(normalize(name)), lambda t: F.transform(F.transform(qgrams(t, config.gram_size), lambda g: canonical(g, config)), lambda g: bit_of(g, config, kind)))
    return F.array_sort(F.array_distinct(F.flatten(each)))


# -- masks and projections


def masks(n: int, config: LinkageConfig = DEFAULT) -> list[list[int]]:
    """Per round the sorted bits of its mask, by hashes: a bit is in with probability
    ``inclusion(n)``; a mask of half the expected size or less is drawn again."""
    p, out = config.inclusion(n), []
    for r in range(config.rounds):
        for attempt in range(64):
            drawn = [b for b in range(config.bits) if hash_unit_of("mask", config.seed, r, attempt, b) / 4294967296.0 <= p]
            if len(drawn) > int(config.bits * p * 0.5):
                break
        out.append(drawn)
    return out


def membership(drawn: list[list[int]], config: LinkageConfig = DEFAULT) -> Column:
    """An array of ``config.bits`` integers: bit r of entry b tells whether b is in mask r."""
    words = [0] * config.bits
    for r, mask in enumerate(drawn):
        for b in mask:
            words[b] |= 1 << r
    return F.array(*[F.lit(w) for w in words])


def project(bits: Column, member: Column, round_: Column) -> Column:
    """The set bits that are in the mask of a round."""
    return F.filter(bits, lambda b: F.getbit(F.element_at(member, (b + 1).cast("int")), round_.cast("int")) == 1)


def projection_key(projected: Column) -> Column:
    """The empty projection has a key too."""
    return F.array_join(projected, ",")


def key_hash(key: Column) -> Column:
    """128 bits of the key, for joins."""
    return F.md5(key)


# -- other forms of vectors


def to_binary_string(bits: Column, length: int) -> Column:
    gaps = F.transform(F.concat(bits, F.array(F.lit(length).cast("long"))), lambda b, i: b - F.coalesce(F.get(bits, i - 1), F.lit(-1)) - 1)
    return F.array_join(F.transform(gaps, lambda n: F.repeat(F.lit("0"), n.cast("int"))), "1")


def from_binary_string(text: Column) -> Column:
    """Raises on characters other than 0 and 1."""
    checked = F.when(text.rlike("^[01]*$"), text).otherwise(F.raise_error(F.lit("a bit string may hold 0 and 1 only")))
    places = F.transform(F.split(checked, ""), lambda c, i: F.when(c == "1", i.cast("long")))
    return F.filter(places, lambda i: i.isNotNull())


def resized(bits: Column, length: int) -> Column:
    """The vector cut, or filled with zeros, to a length."""
    return F.filter(bits, lambda b: b < length)


def to_chunks(bits: Column, config: LinkageConfig = DEFAULT) -> Column:
    """64-bit words, least significant bit first, as decimal(20,0) since the top bit counts."""
    zero = F.lit(0).cast("decimal(20,0)")
    powers = F.array(*[F.lit(str(1 << i)).cast("decimal(20,0)") for i in range(config.chunk_bits)])

    def word(c: Column) -> Column:
        mine = F.filter(bits, lambda b: F.floor(b / config.chunk_bits) == c)
        add = lambda a, b: (a + F.element_at(powers, (b % config.chunk_bits + 1).cast("int"))).cast("decimal(20,0)")
        return F.aggregate(mine, zero, add)

    return F.transform(F.sequence(F.lit(0), F.lit(config.bits // config.chunk_bits - 1)), word)


def to_words(bits: Column, config: LinkageConfig = DEFAULT) -> Column:
    """The same words as signed bigints, for bit operations."""

    def word(c: Column) -> Column:
        mine = F.filter(bits, lambda b: F.shiftright(b, 6) == c)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))))

    return F.transform(F.sequence(F.lit(0), F.lit(config.bits // 64 - 1)), word)


def signed_words(chunks: Column) -> Column:
    """Words as decimal(20,0) -> the same bits as signed bigints."""
    top = F.lit("18446744073709551616").cast("decimal(20,0)")
    return F.transform(chunks, lambda c: F.when(c > F.lit("9223372036854775807").cast("decimal(20,0)"), c - top).otherwise(c).cast("long"))


def pack_bytes(bits: Column, length: int) -> Column:
    """Bytes, least significant bit first; work is in proportion to the set bits."""
    size = -(-length // 8)
    at = lambda b: F.shiftright(b, 3)
    zeros = lambda n: F.repeat(F.lit("00"), n.cast("int"))

    def hexed(bits: Column) -> Column:
        def piece(b: Column, i: Column) -> Column:
            """The first bit of a byte writes it, with the zero bytes since the last one."""
            before = F.coalesce(at(F.get(bits, i - 1)), F.lit(-1))
            mine = F.filter(F.slice(bits, i + 1, F.lit(8)), lambda x: at(x) == at(b))
            byte = F.aggregate(mine, F.lit(0), lambda a, x: a + F.pow(F.lit(2), x % 8).cast("int"))
            return F.when(before < at(b), F.concat(zeros(at(b) - before - 1), F.lpad(F.hex(byte), 2, "0"))).otherwise("")

        last = F.coalesce(at(F.get(bits, F.size(bits) - 1)), F.lit(-1))
        return F.concat(F.array_join(F.transform(bits, piece), ""), zeros(size - 1 - last))

    return F.unhex(let(F.filter(bits, lambda b: b < size * 8), hexed))


def unpack_bytes(packed: Column, length: int) -> Column:
    """The set positions; bytes of zeros are passed over."""
    eight = F.sequence(F.lit(0), F.lit(7))

    def positions(body: Column) -> Column:
        byte = lambda c: F.substring(body, c + 1, F.lit(1))
        some = F.filter(F.sequence(F.lit(0), F.lit(-(-length // 8) - 1)), lambda c: byte(c) != F.unhex(F.lit("00")))

        def places(c: Column) -> Column:
            value = F.conv(F.hex(byte(c)), 16, 10).cast("int")
            return let(value, lambda v: F.transform(F.filter(eight, lambda i: F.getbit(v, i) == 1), lambda i: (c * 8 + i).cast("long")))

        return F.flatten(F.transform(some, places))

    # a column's bytes are copied whenever they are read, those of a lambda's variable are not
    return F.filter(let(packed, positions), lambda b: b < length)
