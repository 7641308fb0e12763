import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from linkwell.config import LinkageConfig
from linkwell.functions import distance, encode, normalize
from linkwell.sources.names import LITERAL_NAMES


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("r"))
    return [r.r for r in rows.orderBy("i").collect()]


def test_config_is_validated():
    for bad in ({"bits": 0}, {"gram_size": 0}, {"representatives": 0}, {"bits": 100}, {"rounds": 32}):
        with pytest.raises(ValueError):
            LinkageConfig(**bad)
    assert abs(LinkageConfig().inclusion(2000) - 0.263754) < 1e-6


def test_fold_tables_fit():
    assert len(normalize.FOLD_FROM) == len(normalize.FOLD_TO)
    assert len(set(normalize.FOLD_FROM)) == len(normalize.FOLD_FROM)


def test_normalize(spark):
    names = ["O'CONNOR SHAUN", "Straße", "Julen.", "Þór", "BARON-COHEN", "a\tb", "Łukasz Ñuño", None, "Ива", "日本"]
    assert column(spark, names, normalize.normalize) == ["OCONNOR SHAUN", "STRAE", "JULEN", "THOR", "BARON COHEN", "A B", "LUKASZ NUNO", "", "IA", ""]
    assert column(spark, ["BARON-COHEN"], lambda c: normalize.normalize(c, True)) == ["BARON-COHEN"]


def test_tokens(spark):
    tokens = lambda c: normalize.tail_tokens(normalize.tokenize(normalize.normalize(c, True)))
    assert column(spark, ["SIMON BARON-COHEN", "X- Y", ""], tokens) == [["SIMON", "BARONCOHEN", "BARON", "BARONCOHEN", "COHEN"], ["X", "Y"], []]
    assert column(spark, ["  ", None, "\t\n", "a"], normalize.is_blank) == [True, True, True, False]


def test_evaluation_normalizer_differs(spark):
    names = ["O'CONNOR", "Straße", "LÃ©na", "Léna", None, "a--b", "Ân"]
    assert column(spark, names, normalize.normalize_for_evaluation) == ["O CONNOR", "STRASSE", "LENA", "LENA", "", "A B", "AN"]


def test_grams_and_bits(spark):
    grams = lambda c: F.flatten(F.transform(normalize.tokenize(normalize.normalize(c)), lambda t: encode.token_grams(t)))
    assert column(spark, ["JULEN", "E", ""], grams) == [["^J", "JU", "LU", "EL", "EN", "N$"], ["^E", "E$"], []]
    murmur = lambda c: encode.encode_token_or(c, kind="murmur")
    assert column(spark, ["JULEN", "E", "O'CONNOR SHAUN", "Straße"], murmur) == [
        [3, 166, 409, 964, 1276, 1667],
        [1933, 1944],
        [314, 409, 863, 908, 952, 1002, 1106, 1384, 1391, 1472, 1867, 1942],
        [267, 1106, 1206, 1301, 1914, 1944],
    ]
    assert [encode.murmur64(g) % 2048 for g in ("^A", "AB", "N$")] == [1591, 463, 409]


def test_literal_pairs_have_their_distances(spark):
    expected = [0, 0, 4, 0, 3, 4, 4, 4, 3, 6, 5, 8, 0, 0, 14, 6, 12, 27, 20]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(LITERAL_NAMES)], "i int, a string, b string")
    bits = lambda c: encode.encode_token_or(F.col(c), kind="murmur")
    got = rows.select("i", distance.hamming(bits("a"), bits("b")).alias("d"), distance.hamming(bits("b"), bits("a")).alias("e")).orderBy("i").collect()
    assert [r.d for r in got] == expected == [r.e for r in got]


def test_other_encoder_settings(spark):
    config = LinkageConfig(bits=1024, gram_size=3)
    v = lambda c: encode.encode_tail_token(c, config)
    a, b, c, d, e = column(spark, ["Alice Smith", "Alice Smith", "SMITH ALICE", "SIMON BARON-COHEN", "SIMON COHEN"], v)
    assert a == b == c and d != e and set(e) < set(d) and max(d) < 1024
    plain = LinkageConfig(boundary_grams=False)
    # grams of the sorted tokens joined cross tokens; those of single tokens do not
    assert len(column(spark, ["AB CD"], lambda c: encode.encode_base(c, plain))[0]) == 3
    assert len(column(spark, ["AB CD"], lambda c: encode.encode_token_or(c, plain))[0]) == 2


def test_forms_of_vectors(spark):
    bits = [[0, 63, 64, 2047], [], [5]]
    kind = "array<bigint>"
    chunks = column(spark, bits, encode.to_chunks, kind)
    assert [int(x) for x in chunks[0][:2]] == [1 + (1 << 63), 1] and int(chunks[0][31]) == 1 << 63 and len(chunks[0]) == 32
    words = column(spark, bits, encode.to_words, kind)
    assert words[0][0] == 1 - (1 << 63) and words[2][0] == 32
    text = column(spark, bits, lambda c: encode.to_binary_string(c, 2048), kind)
    assert [len(t) for t in text] == [2048] * 3 and [i for i, x in enumerate(text[0]) if x == "1"] == bits[0]
    assert column(spark, text, encode.from_binary_string) == bits
    with pytest.raises(Exception, match="0 and 1"):
        column(spark, ["012"], encode.from_binary_string)
    assert column(spark, bits, lambda c: encode.unpack_bytes(encode.pack_bytes(c, 2048), 2048), kind) == bits
    assert column(spark, bits, lambda c: encode.resized(c, 64), kind) == [[0, 63], [], [5]]


def test_distances(spark):
    rows = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], [7]), ([5], [5])], "a array<bigint>, b array<bigint>")
    a, b = F.col("a"), F.col("b")
    got = rows.select(distance.hamming(a, b), distance.xor(a, b), distance.hamming_words(encode.to_words(a), encode.to_words(b))).collect()
    assert [tuple(r) for r in got] == [(2, [1, 4], 2), (1, [7], 1), (0, [], 0)]


def near(a, b, k=1):
    """A plain model of the greedy comparison."""

    def edit(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, last = [i], row
            for j, d in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        return row[-1]

    if len(a) != len(b):
        return False
    left, used = list(b), False
    for t in a:
        if t in left:
            left.remove(t)
            continue
        hit = next((x for x in left if min(len(t), len(x)) >= 4 and edit(t, x) <= k), None)
        if hit is None:
            return False
        left.remove(hit)
        used = True
    return used


def test_near_tokens_against_a_model(spark):
    tokens = st.lists(st.text("AB", min_size=3, max_size=5), max_size=3)

    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.tuples(tokens, tokens), min_size=150, max_size=200))
    def check(pairs):
        rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a array<string>, b array<string>")
        got = rows.select("i", distance.near_token_match(F.col("a"), F.col("b")).alias("r")).orderBy("i").collect()
        assert [r.r for r in got] == [near(*p) for p in pairs]

    check()
    assert near(["BARBARA", "OLIVIA"], ["OLIVIE", "BARBARA"])


def test_marks_of_all_of_unicode(spark):
    """Every assigned character, as names are compared: decomposed, without combining marks."""
    import re
    import unicodedata

    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    plain = lambda s: "".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x))
    key = lambda s: " ".join(re.sub("[^A-Z0-9]+", " ", s.upper()).split())
    step = 200
    rows = [(i, "".join(f"x{c}y " for c in chars[i : i + step])) for i in range(0, len(chars), step)]
    from linkwell.functions import normalize

    df = spark.createDataFrame(rows, "i int, s string").select("i", normalize.strip_diacritics(F.col("s")).alias("s"))
    got = {r.i: r.s for r in df.collect()}
    for i, s in rows:
        assert key(got[i]) == key(plain(s)), i


def test_packing_takes_time_in_proportion(spark):
    length, kind = 300_004, "array<bigint>"
    bits = [[], [0], [7, 8], [300_003], sorted(random.Random(1).sample(range(length), 300)), list(range(64))]
    began = time.perf_counter()
    assert column(spark, bits, lambda c: encode.unpack_bytes(encode.pack_bytes(c, length), length), kind) == bits
    assert time.perf_counter() - began < 60
    for n in (1, 8, 12, 64):
        want = [bytes(sum(1 << k for k in range(8) if 8 * c + k in v) for c in range(-(-n // 8))) for v in bits]
        packed = column(spark, bits, lambda c, n=n: encode.pack_bytes(c, n), kind)
        assert list(map(bytes, packed)) == want
        assert column(spark, want, lambda c, n=n: encode.unpack_bytes(c, n), "binary") == [[b for b in v if b < n] for v in bits]
