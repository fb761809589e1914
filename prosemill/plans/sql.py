"""Pieces of DuckDB SQL that several oracles share."""

WS = r"[\t-\r\x1c-\x1f\x85\p{Z}]"


def collapsed(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{WS}+', ' ', 'g'))"


def words(c: str) -> str:
    return f"list_filter(string_split({collapsed(c)}, ' '), lambda w: w <> '')"


def norm(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


def all_of(c: str, pattern: str) -> str:
    return f"regexp_extract_all(coalesce({c}, ''), '{pattern.replace(chr(39), chr(39) * 2)}')"


def strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^{WS}+|{WS}+$', '', 'g')"


#: Consecutive turns of conversations: what was said and what followed.
TURNS = """
turns AS (
  SELECT conv_id, turn, role, text, lead(text) OVER w AS answer
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)"""


def log_syllables(tokens: str) -> str:
    w = "regexp_replace(lower(x), '[^a-z]', '', 'g')"
    groups = f"len(regexp_extract_all({w}, '[aeiouy]+'))"
    return (
        f"list_transform({tokens}, lambda x: CASE WHEN {w} = '' THEN 0"
        f" ELSE greatest({groups} - (CASE WHEN {w} LIKE '%e' AND {groups} > 1 THEN 1 ELSE 0 END), 1) END)"
    )


def guard_grade(c: str) -> str:
    tokens = all_of(f"lower({c})", r"[\p{L}\p{N}_']+")
    groups = "len(regexp_extract_all(x, '[aeiouy]+'))"
    each = (
        f"CASE WHEN regexp_full_match(x, '\\p{{Nd}}+') THEN 1 ELSE greatest({groups} - (CASE WHEN x LIKE '%e' AND x NOT LIKE '%le'"
        f" AND x NOT LIKE '%ee' AND {groups} > 1 THEN 1 ELSE 0 END), 1) END"
    )
    marks = f"greatest(len(regexp_extract_all(coalesce({c}, ''), '[.!?]+(?:[\\t-\\r ]|$)')), 1)"
    return (
        f"CASE WHEN len({tokens}) = 0 THEN 0.0 ELSE 0.39 * (len({tokens}) / {marks})"
        f" + 11.8 * (list_sum(list_transform({tokens}, lambda x: {each})) / len({tokens})) - 15.59 END"
    )
