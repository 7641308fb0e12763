"""The same queries as SQL, in named steps: what ``steps`` returns is a WITH clause."""

from __future__ import annotations

from linkwell.config import DEFAULT
from linkwell.functions import normalize as nz
from linkwell.operators.synth import NEIGHBOURS, OPERATIONS

C = DEFAULT
SPACE = "\\x09-\\x0D\\x20"


def unit(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT)"


def pick(what: str, n: str) -> str:
    return f"({unit(repr(what), str(C.seed), 'idx')} % ({n}))"


def folded(x: str, keep_hyphen: bool = False) -> str:
    s = f"coalesce({x}, '')"
    for letter, two in nz.FOLD_TO_TWO.items():
        s = f"replace({s}, '{letter}', '{two}')"
    s = f"translate({s}, '{nz.FOLD_FROM}', '{nz.FOLD_TO}')"
    s = f"regexp_replace(regexp_replace({s}, '[^A-Za-z0-9{SPACE}-]', '', 'g'), '[{SPACE}]', ' ', 'g')"
    return f"upper({s})" if keep_hyphen else f"upper(replace({s}, '-', ' '))"


def tokens(clean: str) -> str:
    return f"list_filter(string_split({clean}, ' '), lambda t: t <> '')"


def canon(g: str) -> str:
    return f"(CASE WHEN NOT contains({g}, '^') AND NOT contains({g}, '$') AND substr({g}, 2, 1) < substr({g}, 1, 1) THEN reverse({g}) ELSE {g} END)"


def grams(t: str, canonical: bool = True) -> str:
    g = f"substr('^' || {t} || '$', i, 2)"
    return f"list_transform(range(1, length({t}) + 2), lambda i: {canon(g) if canonical else g})"


def bit(g: str) -> str:
    return f"(CAST(('0x' || substr(md5({g}), 1, 8)) AS BIGINT) % {C.bits})"


def bits(toks: str) -> str:
    g = f"flatten(list_transform(list_filter({toks}, lambda t: t <> ''), lambda t: {grams('t')}))"
    return f"list_sort(list_distinct(list_transform({g}, lambda g: {bit('g')})))"


def tail(toks: str) -> str:
    at = "instr(t, '-')"
    parts = f"CASE WHEN {at} > 0 AND {at} < length(t) THEN [substr(t, 1, {at} - 1), substr(t, 1, {at} - 1) || substr(t, {at} + 1), substr(t, {at} + 1)] ELSE CAST([] AS VARCHAR[]) END"
    return f"list_transform(list_concat({toks}, flatten(list_transform({toks}, lambda t: {parts}))), lambda t: replace(t, '-', ''))"


def evaluated(x: str) -> str:
    return f"trim(regexp_replace(upper(replace(translate(coalesce({x}, ''), '{nz.ACCENT_FROM}', '{nz.ACCENT_TO}'), 'ß', 'SS')), '[^A-Z0-9]+', ' ', 'g'))"


def spliced(at: str, cut: str, put: str, s: str = "s") -> str:
    return f"(substr({s}, 1, CAST({at} - 1 AS BIGINT)) || {put} || substr({s}, CAST({at} + {cut} AS BIGINT)))"


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter(what: str) -> str:
    return f"substr('{LETTERS}', {pick(what, '26')} + 1, 1)"


def cased(new: str, old: str) -> str:
    return f"(CASE WHEN lower({old}) <> {old} THEN upper({new}) ELSE {new} END)"


def one(at: str) -> str:
    return f"substr(s, {at}, 1)"


NEAR = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in NEIGHBOURS.items()) + "}"
BESIDE = f"{NEAR}[lower({one('p')})]"
SUBSTITUTE = f"coalesce({cased(f'substr({BESIDE}, {pick("neighbour", f"length({BESIDE})")} + 1, 1)', one('p'))}, {letter('letter')})"
OTHER = "(CASE WHEN p < length(s) THEN p + 1 ELSE p - 1 END)"
VOWEL = f"vowels[CAST({pick('vowel', 'greatest(len(vowels), 1)')} + 1 AS BIGINT)]"
OTHERS = f"replace('aeiou', lower({one(VOWEL)}), '')"
RESULTS = {
    "deletion": f"CASE WHEN length(s) > 1 THEN {spliced('p', '1', repr(''))} END",
    "insertion": spliced("p", "0", letter("letter")),
    "substitution": spliced("p", "1", SUBSTITUTE),
    "transposition": f"CASE WHEN length(s) > 1 THEN {spliced(f'least(p, {OTHER})', '2', f'{one(f"greatest(p, {OTHER})")} || {one(f"least(p, {OTHER})")}')} END",
    "vowel_swap": f"CASE WHEN len(vowels) > 0 THEN {spliced(VOWEL, '1', cased(f'substr({OTHERS}, {pick("vowel2", "4")} + 1, 1)', one(VOWEL)))} END",
    "diacritic_drop": "CASE WHEN plain <> s THEN plain END",
    "equivalent_forename": "NULL",
    "drop_middle": "CASE WHEN len(words) = 3 THEN words[1] || ' ' || words[3] END",
    "abbrev_middle": "CASE WHEN len(words) = 3 THEN words[1] || '. ' || substr(words[2], 1, 1) || '. ' || words[3] END",
    "abbrev_forename": "CASE WHEN len(words) = 3 THEN substr(words[1], 1, 1) || '. ' || substr(words[2], 1, 1) || '. ' || words[3] WHEN len(words) = 2 THEN substr(words[1], 1, 1) || '. ' || words[2] END",
    "name_swap": "CASE WHEN len(words) = 3 THEN words[3] || ' ' || words[1] || ' ' || words[2] WHEN len(words) = 2 THEN words[2] || ' ' || words[1] END",
}

#: name: (what it needs, body)
STEPS: dict[str, tuple[str, str]] = {
    "clean": (
        "",
        "SELECT idx, CASE WHEN n > 0 THEN concat_ws(' ', w[n // 4 + 1], w[n * 2 // 4 + 1], w[n * 3 // 4 + 1]) ELSE '' END AS name FROM "
        "(SELECT doc_id AS idx, regexp_extract_all(coalesce(text, ''), '[^ \\n.,!?;:]+') AS w, len(w) AS n FROM documents)",
    ),
    "drawn": (
        "clean",
        f"""SELECT *, {pick('place', 'greatest(len(letters), 1)')} AS at_p, {pick('place2', 'greatest(len(letters), 1)')} AS at_q,
          [{', '.join(repr(o) for o in OPERATIONS)}][CAST({pick('op', str(len(OPERATIONS)))} + 1 AS BIGINT)] AS op,
          coalesce(letters[CAST(at_p + 1 AS BIGINT)], 1) AS p, coalesce(letters[CAST(at_q + 1 AS BIGINT)], 1) AS q,
          list_filter(letters, lambda x: lower(substr(s, x, 1)) IN ('a', 'e', 'i', 'o', 'u')) AS vowels,
          list_filter(string_split_regex(s, '\\s+'), lambda t: t <> '') AS words, translate(s, '{nz.ACCENT_FROM}', '{nz.ACCENT_TO}') AS plain
        FROM (SELECT *, trim(name) AS s, list_filter(range(1, greatest(length(s), 1) + 1), lambda x: regexp_matches(substr(s, x, 1), '\\p{{L}}')) AS letters FROM clean)""",
    ),
    "fuzzy": (
        "drawn",
        f"""SELECT idx, name, CASE WHEN noisy THEN coalesce(result, {spliced('q', '1', letter('letter2'))}) ELSE name END AS fuzzy_name,
          CASE WHEN NOT noisy THEN 'none' WHEN result IS NULL THEN 'substitution_fallback' ELSE op END AS error_type, noisy AS is_noisy
        FROM (SELECT *, CASE op {' '.join(f"WHEN '{o}' THEN {x}" for o, x in RESULTS.items())} END AS result,
          ({unit("'noise'", str(C.seed), 'idx')} / 4294967296.0::DOUBLE < {C.noise_rate}::DOUBLE) AND regexp_replace(name, '[{SPACE}]', '', 'g') <> '' AND len(letters) > 0 AS noisy FROM drawn)""",
    ),
    "records": (
        "fuzzy",
        f"""SELECT *, regexp_replace(name, '[{SPACE}]', '', 'g') <> '' AS valid FROM
          (SELECT CAST(0 AS BIGINT) AS party, idx, name FROM clean UNION ALL SELECT 1, idx, fuzzy_name FROM fuzzy)""",
    ),
    "enc": ("records", f"SELECT party, idx, name, {bits(tokens(folded('name')))} AS bits FROM records WHERE valid"),
    "masks": (
        "clean",
        f"""SELECT r.range AS round, b.range AS bit FROM range({C.rounds}) r, range({C.bits}) b
        WHERE {unit("'mask'", str(C.seed), 'r.range', '0', 'b.range')} / 4294967296.0::DOUBLE
          <= 1.0::DOUBLE - pow(greatest((SELECT count(*) FROM clean), 1)::DOUBLE * {C.gap_factor}, -1.0::DOUBLE / {C.threshold * (C.gap_factor - 1.0)})""",
    ),
    "mask_lists": ("masks", "SELECT round, list(bit ORDER BY bit) AS mask FROM masks GROUP BY round"),
    "proj": (
        "enc mask_lists",
        "SELECT round, party, idx, bits, list_sort(list_intersect(bits, mask)) AS projected, array_to_string(projected, ',') AS key FROM enc, mask_lists",
    ),
    "capped": (
        "proj",
        f"""SELECT * FROM (SELECT round, party, idx, md5(key) AS key_hash, row_number() OVER (PARTITION BY round, party, key
          ORDER BY {unit("'pick'", str(C.seed), 'round', 'party', 'idx')}, idx) AS place FROM proj) WHERE place <= {C.representatives}""",
    ),
    "met": (
        "capped",
        """SELECT * FROM (SELECT round, key_hash, coalesce(list(idx ORDER BY idx) FILTER (party = 0), []) AS a, coalesce(list(idx ORDER BY idx) FILTER (party = 1), []) AS b
          FROM capped GROUP BY round, key_hash) WHERE len(a) > 0 AND len(b) > 0""",
    ),
    "expanded": ("capped", "SELECT x.round, x.key_hash, x.idx AS a_idx, y.idx AS b_idx FROM capped x JOIN capped y ON x.round = y.round AND x.key_hash = y.key_hash AND x.party = 0 AND y.party = 1"),
    "cand": ("expanded", "SELECT a_idx, b_idx, min(round) AS round FROM expanded GROUP BY a_idx, b_idx"),
    "ids": ("cand", "SELECT row_number() OVER (ORDER BY round, a_idx // 4096, a_idx, b_idx) - 1 AS candidate_id, round, a_idx, b_idx FROM cand"),
    "paired": (
        "ids enc",
        """SELECT candidate_id, round, a_idx, x.name AS a_name, x.bits AS a_bits, b_idx, y.name AS b_name, y.bits AS b_bits,
          len(x.bits) + len(y.bits) - 2 * len(list_intersect(x.bits, y.bits)) AS d
        FROM ids JOIN enc x ON x.party = 0 AND x.idx = a_idx JOIN enc y ON y.party = 1 AND y.idx = b_idx""",
    ),
    "matches": ("paired", f"SELECT round, a_idx, a_name, b_idx, b_name, CAST(0 AS BIGINT) AS proj_dist, d AS payload_dist FROM paired WHERE d <= {C.threshold}"),
    "normed": (
        "matches",
        f"""SELECT *, {evaluated('a_name')} AS a_norm, {evaluated('b_name')} AS b_norm, {tokens('a_norm')} AS ta, {tokens('b_norm')} AS tb,
          array_to_string(list_sort(ta), ' ') AS a_sorted_key, array_to_string(list_sort(tb), ' ') AS b_sorted_key,
          array_to_string(list_sort(list_distinct(ta)), ' ') AS a_unique_key, array_to_string(list_sort(list_distinct(tb)), ' ') AS b_unique_key FROM matches""",
    ),
    "near": (
        "normed",
        """SELECT a_idx, b_idx, 1 AS step, ta, tb AS remaining, false AS used, true AS ok FROM normed WHERE len(ta) = len(tb) AND a_idx <> b_idx
        UNION ALL
        SELECT a_idx, b_idx, step + 1, ta, CASE WHEN hit > 0 THEN list_concat(remaining[1 : hit - 1], remaining[hit + 1 :]) ELSE remaining END, used OR (exact = 0 AND hit > 0), ok AND hit > 0
        FROM (SELECT *, coalesce(list_position(remaining, ta[step]), 0) AS exact,
            CASE WHEN exact > 0 THEN exact ELSE coalesce(list_position(list_transform(remaining, lambda x: least(length(x), length(ta[step])) >= 4 AND levenshtein(x, ta[step]) <= 1), true), 0) END AS hit
          FROM near WHERE step <= len(ta))""",
    ),
    "near_pairs": ("near", "SELECT a_idx, b_idx FROM near WHERE step = len(ta) + 1 AND used AND ok"),
    "classified": (
        "near_pairs normed",
        """SELECT round, n.a_idx, a_name, n.b_idx, b_name, proj_dist, payload_dist, a_norm, b_norm, a_sorted_key, b_sorted_key, a_unique_key, b_unique_key,
          CASE WHEN n.a_idx = n.b_idx THEN 'index_match' WHEN a_norm = b_norm THEN 'exact_normalised_name' WHEN a_sorted_key = b_sorted_key THEN 'token_order_equivalent'
            WHEN a_unique_key = b_unique_key THEN 'duplicate_token_equivalent'
            WHEN len(list_distinct(ta)) >= 2 AND len(list_distinct(tb)) >= 2 AND (list_has_all(tb, ta) OR list_has_all(ta, tb)) THEN 'missing_or_extra_token'
            WHEN p.a_idx IS NOT NULL THEN 'near_token_edit_distance_le_1' ELSE 'possible_false_positive' END AS reason
        FROM normed n LEFT JOIN near_pairs p ON n.a_idx = p.a_idx AND n.b_idx = p.b_idx""",
    ),
    "expected": ("fuzzy", f"SELECT * FROM fuzzy WHERE regexp_replace(name, '[{SPACE}]', '', 'g') <> '' AND regexp_replace(fuzzy_name, '[{SPACE}]', '', 'g') <> ''"),
    "missed": (
        "expected matches",
        f"""SELECT idx, name AS clean_name, fuzzy_name, error_type, is_noisy, {evaluated('name')} AS clean_norm, {evaluated('fuzzy_name')} AS fuzzy_norm,
          array_to_string(list_sort({tokens('clean_norm')}), ' ') AS clean_sorted_key, array_to_string(list_sort({tokens('fuzzy_norm')}), ' ') AS fuzzy_sorted_key
        FROM expected WHERE idx NOT IN (SELECT a_idx FROM matches WHERE a_idx = b_idx)""",
    ),
    "words64": (
        "enc",
        "SELECT party, idx, list_transform(range(32), lambda c: list_sum(list_prepend(0::HUGEINT, list_transform(list_filter(bits, lambda b: b // 64 = c), lambda b: CAST(pow(2, b % 64) AS HUGEINT))))) AS chunks FROM enc",
    ),
}


def needed(names: str, seen: list[str] | None = None) -> list[str]:
    seen = [] if seen is None else seen
    for name in names.split():
        if name not in seen:
            needed(STEPS[name][0], seen)
            seen.append(name)
    return seen


def query(names: str, select: str) -> str:
    steps = needed(names)
    once = {"clean", "fuzzy", "enc", "proj", "capped", "expanded", "cand", "ids", "paired", "matches", "normed", "mask_lists"}
    ctes = [f"{n} AS {'MATERIALIZED ' if n in once else ''}({STEPS[n][1]})" for n in steps]
    return f"WITH RECURSIVE {', '.join(ctes)} {select}"
