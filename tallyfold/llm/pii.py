"""Personal data: each entity is replaced by a keyed surrogate, with DataFrame functions only.

A surrogate has its entity's type, gender, script and format: letters and digits are drawn from an HMAC of the
canonical entity, laid out with the entity's own separators and case. Card numbers keep their first digit and
account numbers their country, both with right check digits; addresses stay addresses; key prefixes, country
codes and top-level domains stay.

Names are known by a form of address before them, and then wherever their words recur in the same text. Each
word is an entity of its own, with the gender of its form of address, or else the first that the text gives it: so
`Mrs. Anna Kern`, `Frau Kern` and `Anna` agree; forms of address and particles (`de`, `von`) stay. A word may have inner
capitals, hyphens and apostrophes, and stands as a whole; a word in capitals is the same name. A name that is a common
word (COMMON) does not recur at the start of a sentence. The canonical form of an e-mail address is in lower case, of a card, account or
social security number without separators, of a phone number its last ten digits.

Coreference holds because the HMAC sees the canonical entity alone. Distinctness is checked over the whole corpus:
where two entities of one type would meet in one surrogate, or a surrogate is itself an entity, the HMAC is drawn
again, and names, mail and network addresses and secrets get longer with each attempt. Types of fixed length may
run out of numbers; after ROUNDS attempts that is an error that names the type.

Not detected: names without a form of address in their text, dates of birth, streets, numbers with wrong check digits.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_columns, lookup, make_room, prepare, written

#: Redrawn entities that a literal map may hold; more go by joins.
MAP_ENTRIES = 4096
#: Attempts for one entity.
ROUNDS = 32
SEP = "\ue000\ue001"  # private-use characters; texts that have the first are parsed without marks
#: Forms of address by gender, words that follow them without being names, and the letters and endings of made-up names.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "Госпожа")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "Господин")
NEUTRAL = ("Mx", "Dr", "Prof", "Dear")
NO_NAMES = ("Sir", "Madam", "Customer", "Team", "Hiring", "President", "Chairman", "Speaker", "Minister", "Friend", "All")
PARTICLES = ("de", "del", "della", "den", "der", "di", "da", "do", "dos", "du", "la", "le", "van", "von", "zu", "zur", "ten", "ter", "al", "bin", "el", "y")
#: Names that are common words as well; at the start of a sentence they are taken for these.
COMMON = (
    "April", "Art", "August", "Bill", "Black", "Brown", "Chance", "Chase", "Christian", "Dean", "Faith", "Frank", "Grace", "Grant", "Green", "Hope", "Joy", "June",
    "King", "Long", "Love", "Mark", "May", "Miles", "Page", "Pat", "Penny", "Price", "Rich", "Rob", "Rose", "Rush", "Short", "Sue", "Summer", "Welch", "White", "Will", "Wood", "Young",
)
CONSONANTS = {"latin": "bdfgklmnprstvzhj", "cyrillic": "бдфгклмнпрствзхж"}
VOWELS = {"latin": "aeio", "cyrillic": "аеио"}
ENDINGS = {("latin", "f"): "na", ("latin", "m"): "rt", ("latin", "n"): "l", ("cyrillic", "f"): "на", ("cyrillic", "m"): "рт", ("cyrillic", "n"): "л"}

_TITLE = r"(?:" + "|".join(FEMALE + MALE + NEUTRAL[:-1]) + r")\.?"
_PARTICLE = r"(?:" + "|".join(PARTICLES) + ")"
_WORD = rf"(?:{_PARTICLE} ){{0,3}}(?!(?:" + "|".join(NO_NAMES) + r")(?!\p{L}))\p{Lu}['’]?\p{L}++(?:['’\-]\p{L}++){0,3}+"
#: Countries of account numbers.
COUNTRIES = "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK"

_START = r"(?<![\p{L}\p{N}])"
_ASKED = r"\b(?i:password|passwd|pwd|token|secret|api_key|apikey)\s{0,3}[=:]\s{0,3}[\"']?"
_HEX = "[0-9A-Fa-f]{1,4}"
KINDS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@(?:[A-Za-z0-9][A-Za-z0-9\-]{0,62}\.){1,16}[A-Za-z]{2,24}",
    "key": _START + r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": rf"(?<={_ASKED})[A-Za-z0-9+/_\-]{{8,}}",
    "name": _START + rf"(?:{_TITLE} (?:{_TITLE} )?{_WORD}(?: {_WORD})?|Dear {_WORD} {_WORD})",
    "iban": _START + rf"(?:{COUNTRIES.replace(' ', '|')})" + r"\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)",
    "ipv6": rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,5}})(?![\w:])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\d\-])(?:(?:\d{4}[ \-]?){3}\d{4}|\d{4}[ \-]?\d{6}[ \-]?\d{5}|\d{13,19})(?!\d)",
    "phone": r"(?<![\d])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)|\+\d{7,15}(?!\d)",
}
#: Not at the start of a sentence.
_INSIDE = r"(?<![.!?:;\n]\s)(?<![\n])(?<!\A)"
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
HINT = rf"[0-9@]|(?i:password|passwd|pwd|token|secret|api_?key)\s{{0,3}}[=:]|{_START}(?:AKIA|ASIA)[A-Z0-9]{{16}}|{_START}(?:{_TITLE}|Dear) (?:{_PARTICLE} )?\p{{Lu}}|(?:[A-Fa-f]{{1,4}}::?){{2}}"
PARTS = "array<struct<x: string, k: string, u: array<string>>>"


def q(s: str) -> str:
    return "r'" + s.replace("'", r"\x27") + "'"


def let(name: str, value: str, body: str) -> str:
    """SQL of body, in which name stands for value."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


# ---------------------------------------------------------------- what is there


def _gender(v: str) -> str:
    told = lambda forms: q("(?:^| )(?:" + "|".join(forms) + r")(?!\p{L})")
    return f"CASE WHEN rlike({v}, {told(FEMALE)}) THEN 'f' WHEN rlike({v}, {told(MALE)}) THEN 'm' ELSE 'n' END"


def _kept(w: str) -> str:
    """Whether a word of a name stays: a form of address or a particle."""
    return f"rlike({w}, {q('^(?:' + _TITLE + '|Dear|' + _PARTICLE + ')$')})"


def _name_words(v: str) -> str:
    return f"filter(split({v}, ' '), w -> NOT {_kept('w')})"


def _one_case(w: str) -> str:
    """A name in capitals is the name."""
    return f"IF({w} = upper({w}), initcap({w}), {w})"


def _who(text: str) -> str:
    """Array of (w, g): the words of the names in a text, each with the first gender that the text gives it, else n."""
    told = f"flatten(transform(regexp_extract_all({text}, {q(KINDS['name'])}, 0), v -> transform({_name_words('v')}, w -> struct(w AS w, {_gender('v')} AS g))))"
    return let(
        "told", told,
        "transform(array_distinct(transform(told, t -> t.w)), w -> struct(w AS w, coalesce(get(filter(told, t -> t.w = w AND t.g != 'n'), 0).g, 'n') AS g))"
    )


def _luhn(v: str) -> str:
    """Digit sum with every second digit from the right, not the last, doubled (less 9 if over 9)."""
    return f"aggregate(transform(reverse(split({v}, '')), (d, j) -> IF(j % 2 = 0, cast(d as int), (cast(d as int) * 2) - IF(cast(d as int) > 4, 9, 0))), 0, (x, y) -> x + y)"


def _mod97(v: str) -> str:
    """The remainder by 97 of the number that letters (A: 10, and so on) and digits make."""
    return f"aggregate(split({v}, ''), 0, (x, c) -> CASE WHEN c = '' THEN x WHEN c <= '9' THEN (x * 10 + cast(c as int)) % 97 ELSE (x * 100 + ascii(c) - 55) % 97 END)"


def kind_sql(v: str, before: str) -> str:
    """The kind of a match of ANY after the text `before`; '' for numbers with wrong check digits that are no secret."""
    secret = f"IF(rlike({before}, {q(_ASKED + '$')}), 'secret', '')"
    sound = {
        "card": f"{_luhn(canonical_sql(chr(39) + 'card' + chr(39), v))} % 10 = 0",
        "iban": let("n", canonical_sql("'iban'", v), f"{_mod97('concat(substring(n, 5), substring(n, 1, 4))')} = 1")
    }
    cases = " ".join(
        f"WHEN rlike({v}, {q('^(?:' + p + ')$')}) THEN " + (f"IF({sound[k]}, '{k}', {secret})" if k in sound else f"'{k}'") for k,
        p in KINDS.items() if k != "secret"
    )
    return f"(CASE {cases} ELSE 'secret' END)"


def canonical_sql(k: str, v: str) -> str:
    digits = f"regexp_replace({v}, '[^0-9]', '')"
    return f"(CASE WHEN {k} = 'phone' THEN right({digits}, 10) WHEN {k} IN ('card', 'ssn') THEN {digits} WHEN {k} = 'iban' THEN replace({v}, ' ', '') WHEN {k} IN ('email', 'ipv6') THEN lower({v}) ELSE {v} END)"


def marked(text: Column, pattern: Column) -> Column:
    """The text as an array: plain, match, plain, match, ..., plain."""
    by_mark = F.split(F.regexp_replace(text, pattern, F.lit(f"{SEP}$0{SEP}")), SEP, -1)
    plain, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    woven = F.flatten(F.transform(plain, lambda x, i: F.array(x, F.coalesce(F.get(found, i), F.lit("")))))
    return F.when(text.contains(SEP[0]), F.slice(woven, F.lit(1), F.size(woven) - 1)).otherwise(by_mark)


def parts(text: Column) -> Column:
    """PARTS of a text: x, the piece; k, its kind ('' for plain text); u, the entities in it, as
    kind|canonical form; of a name, for each word of it, '' for those that stay.
    """
    # a bounded run of names: a longer one goes on in the next match
    word = F.array_join(F.transform("__who.w", lambda w: F.when(w.isin(*COMMON), F.concat(F.lit(_INSIDE), w)).otherwise(w)), "|")
    bare = F.concat(F.lit(ANY + "|" + _START + "(?:"), word, F.lit(")(?: (?:"), word, F.lit(r")){0,7}(?!['’\-]?\p{L})"))
    cut = F.when(F.size("__who") > 0, marked(text, bare)).otherwise(marked(text, F.lit(ANY)))
    cut = F.when(text.isNull(), F.array(F.lit(""))).when(~text.rlike(HINT), F.array(text)).otherwise(cut)
    of_text = "(size(__who) > 0 AND forall(split(x, ' '), w -> exists(__who, p -> p.w = w)))"  # no form of address
    units = f"CASE k WHEN '' THEN cast(array() as array<string>) WHEN 'name' THEN transform(split(x, ' '), w -> IF({_kept('w')}, '', concat('name|', coalesce(nullif({_gender('x')}, 'n'), get(filter(__who, p -> p.w = w), 0).g, 'n'), ':', {_one_case('w')}))) ELSE array(concat(k, '|', {canonical_sql('k', 'x')})) END"
    struct = let(
        "k", f"CASE WHEN i % 2 = 0 THEN '' WHEN {of_text} THEN 'name' ELSE {kind_sql('x', 'get(__cut, i - 1).x')} END",
        f"struct(x AS x, k AS k, {units} AS u)"
    )
    return F.transform(cut, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), f"transform(__cut, y -> {let('x', 'y.x', let('i', 'y.i', struct))})"


# ---------------------------------------------------------------- what takes its place


def pads(key: str | bytes) -> tuple[str, str]:
    """SQL of the HMAC's inner and outer pad, of a key derived from the given one."""
    derived = hashlib.sha512(b"surrogates\0" + (key.encode() if isinstance(key, str) else key)).digest().ljust(128, b"\0")
    return tuple(f"X'{bytes(b ^ p for b in derived).hex()}'" for p in (0x36, 0x5C))


def _byte(i: str) -> str:
    """Number i of the 256 keyed bytes in hex."""
    return f"cast(conv(substring(hex, 2 * (({i}) % 256) + 1, 2), 16, 10) as int)"


def _drawn(v: str, keep: str, letters: str = "'abcdefghijklmnopqrstuvwxyz'") -> str:
    """v with its ASCII letters and digits, but for the first `keep` characters, drawn anew."""
    b = _byte("i")
    return (
        f"array_join(transform(split({v}, ''), (c, i) -> CASE WHEN i < {keep} THEN c WHEN c >= '0' AND c <= '9' THEN cast({b} % 10 as string) "
        f"WHEN c >= 'a' AND c <= 'z' THEN substring({letters}, {b} % length({letters}) + 1, 1) WHEN c >= 'A' AND c <= 'Z' THEN upper(substring({letters}, {b} % length({letters}) + 1, 1)) ELSE c END), '')"
    )


def _extra(n: str) -> str:
    """n more letters."""
    return f"array_join(transform(IF({n} > 0, sequence(1, {n}), cast(array() as array<int>)), j -> substring('abcdefghijklmnopqrstuvwxyz', {_byte('255 - j')} % 26 + 1, 1)), '')"


def _name(v: str, attempt: str) -> str:
    """Of gender:Word, a word of its script with an ending of its gender, about as long."""

    def made(script: str) -> str:
        j = f"{_byte('j')} % 64"
        letters = f"concat(substring('{CONSONANTS[script]}', ({j}) div 4 + 1, 1), substring('{VOWELS[script]}', ({j}) % 4 + 1, 1))"
        ending = f"CASE substring({v}, 1, 1) " + " ".join(f"WHEN '{g}' THEN '{e}'" for (s, g), e in ENDINGS.items() if s == script) + " END"
        return f"initcap(concat(array_join(transform(sequence(1, least(4, greatest(2, cast(length({v}) / 3 as int))) + {attempt}), j -> {letters}), ''), {ending}))"

    return f"IF(rlike({v}, {q('[Ѐ-ӿ]')}), {made('cyrillic')}, {made('latin')})"


def surrogate_sql(k: str, v: str, attempt: str, key: tuple[str, str]) -> str:
    """The canonical surrogate of the canonical entity v of kind k, in SQL; `hex` is bound by a lambda."""
    inner, outer = key
    message = lambda n: f"encode(concat_ws('|', '{n}', {k}, cast({attempt} as string), {v}), 'UTF-8')"
    stream = "concat(" + ", ".join(f"sha2(concat({outer}, unhex(sha2(concat({inner}, {message(n)}), 512))), 512)" for n in range(4)) + ")"
    octet = f"CASE WHEN {attempt} = 0 AND length(o) = 1 THEN {_byte('2 * i')} % 10 WHEN {attempt} = 0 AND length(o) = 2 THEN 10 + {_byte('2 * i')} % 90 ELSE 100 + (256 * {_byte('2 * i')} + {_byte('2 * i + 1')}) % 156 END"
    group = f"array_join(transform(sequence(1, IF({attempt} > 0, 4, length(o))), j -> substring('0123456789abcdef', {_byte('4 * i + j')} % 16 + 1, 1)), '')"
    body = _drawn(f"substring({v}, 1, length({v}) - 1)", "1")
    tail = f"substring_index({v}, '.', -1)"
    hexes = f"IF(rlike({v}, '^[0-9a-f]+$'), 'abcdef', 'abcdefghijklmnopqrstuvwxyz')"
    account = let(
        "b", f"substring({_drawn(v, '4')}, 5)",
        f"concat(substring({v}, 1, 2), lpad(cast(98 - {_mod97(f'concat(b, substring({v}, 1, 2), {chr(39)}00{chr(39)})')} as string), 2, '0'), b)"
    )
    made = (
        f"CASE {k} WHEN 'email' THEN concat({_extra(f'2 * {attempt}')}, {_drawn(f'substring({v}, 1, length({v}) - length({tail}))', '0')}, {tail}) "
        f"WHEN 'ip' THEN array_join(transform(split({v}, {q(chr(92) + '.')}), (o, i) -> {octet}), '.') "
        f"WHEN 'ipv6' THEN array_join(transform(split({v}, ':'), (o, i) -> IF(o = '', '', {group})), ':') WHEN 'iban' THEN {account} "
        f"WHEN 'card' THEN {let('b', body, f'concat(b, cast(pmod(-{_luhn(f"concat(b, 0)")}, 10) as string))')} "
        f"WHEN 'key' THEN {_drawn(v, '4')} WHEN 'name' THEN {_name(v, attempt)} "
        f"WHEN 'secret' THEN concat({let('ls', hexes, _drawn(v, '0', 'ls'))}, {_extra(attempt)}) ELSE {_drawn(v, '0')} END"
    )
    return let("hex", stream, made)


def layout_sql(k: str, v: str, s: str) -> str:
    """The canonical surrogate s in the format of the entity v: separators and case are v's, and so is what s is too short for, at the front."""
    at = "length(regexp_replace(substring(v, 1, i + 1), '[^A-Za-z0-9]', ''))"
    ahead = "length(regexp_replace(v, '[^A-Za-z0-9]', '')) - length(s)"
    filled = f"array_join(transform(split(v, ''), (c, i) -> IF(rlike(c, '[A-Za-z0-9]') AND {at} > {ahead}, substring(s, {at} - ({ahead}), 1), c)), '')"
    upper = "IF(rlike(v, '[A-F]'), upper(s), s)"
    cased = "concat(substring(s, 1, length(s) - length(v)), array_join(transform(split(v, ''), (c, i) -> let_c), ''))".replace(
        "let_c", let("d", "substring(s, length(s) - length(v) + i + 1, 1)", "IF(c >= 'A' AND c <= 'Z', upper(d), d)")
    )
    return let(
        "v", v,
        let(
            "s", s,
            f"(CASE WHEN {k} IN ('phone', 'card', 'ssn', 'iban') THEN {filled} WHEN {k} = 'email' THEN {cased} WHEN {k} = 'ipv6' THEN {upper} ELSE s END)"
        )
    )


def draw(entities: DataFrame, key: tuple[str, str]) -> tuple[DataFrame, int]:
    """entities(unit, distinct: kind|canonical form) that need an attempt over 0, as unit, attempt, and their number.

    Of entities that meet in a surrogate the least keeps it and the others draw again; so does one whose surrogate is
    an entity, or was drawn before by any. Each round looks at those that still wait, and reads what was drawn so far.
    """
    split_ = entities.select("unit", F.substring_index("unit", "|", 1).alias("k"), F.expr("substring(unit, instr(unit, '|') + 1)").alias("canon"))
    real = F.when(F.col("k") == "name", F.expr("substring(canon, 3)")).otherwise(F.col("canon"))
    known = written(split_.select("unit", "k", "canon", real.alias("s")), "known")
    waiting, drawn, over = known.select("unit", "k", "canon"), [], []
    for attempt in range(ROUNDS):
        now = written(waiting.select("unit", "k", "canon", F.expr(surrogate_sql("k", "canon", f"{attempt}", key)).alias("s")), "drawn")
        taken = reduce(DataFrame.unionByName, [d.select("k", "s") for d in (known, *drawn)])
        met = now.groupBy("k", "s").agg(F.min("unit").alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1")
        lost = now.join(met, ["k", "s"]).where("unit != least").select("unit", "k", "canon").unionByName(
            now.join(taken, ["k", "s"], "left_semi").select("unit", "k", "canon")
        )
        again = written(lost.distinct(), "redraws")
        drawn.append(now)
        if attempt:
            over.append(now.join(again.select("unit"), "unit", "left_anti").select("unit", F.lit(attempt).alias("attempt")))
        if not again.count():
            found = reduce(DataFrame.unionByName, over) if over else now.limit(0).select("unit", F.lit(0).alias("attempt"))
            found = written(found, "attempts")
            return found, found.count()
        waiting = again
    kinds = sorted(r["k"] for r in waiting.select("k").distinct().collect())  # one row a kind
    raise ValueError(f"no free surrogates after {ROUNDS} attempts for {kinds}")


def pseudonymise(docs: DataFrame, key: str | bytes, text: str = "text") -> DataFrame:
    """docs with the text rewritten, and n_entities.

    `key` is the secret: the same key gives the same surrogates to the same set of entities. It must not be empty; any
    characters count. The plan holds a key derived from it, which also tells surrogates, so plans and logs are as
    secret as the mapping.

    Null and empty texts stay as they are, with no entities; texts of any length are read whole. Equal entities get equal
    surrogates in all rows, different ones of a type different ones; repeated rows get equal texts. An empty table
    gives an empty one. Other columns stay; one named n_entities or __* stays as <name>_in.
    """
    if not key:
        raise ValueError("a key is needed")
    prepare(docs.sparkSession)
    secret = pads(key)
    columns = (docs := make_room(docs, "n_entities", "__parts", "__who", "__cut", "__h1", "__h2", "__over", "__many", "__none")).columns
    who = F.when(F.col(text).rlike(KINDS["name"]), F.expr(_who(f"`{text}`"))).otherwise(F.expr("cast(array() as array<struct<w: string, g: string>>)"))
    cut, found = parts(F.col(text))
    parsed = docs.withColumn("__who", who).withColumn("__cut", cut)
    parsed = written(
        parsed.select(*(f"`{c}`" for c in columns if c != text), F.col(text).isNull().alias("__none"), F.expr(found).cast(PARTS).alias("__parts")),
        "parsed"
    )
    units = F.array_distinct(F.filter(F.flatten(F.transform("__parts", lambda p: p["u"])), lambda u: u != ""))
    over, n = draw(written(parsed.select(F.explode(units).alias("unit")).distinct(), "entities"), secret)
    if n <= MAP_ENTRIES:
        pairs = [x for r in over.collect() for x in (F.lit(r["unit"]), F.lit(r["attempt"]))]  # MAP_ENTRIES at most
        parsed = parsed.withColumn("__over", F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string, int>)"))
    else:
        parsed = _with_redraws(parsed, over, units)
    made = lambda unit: let(
        "t", unit,
        let("a", "coalesce(__over[t], 0)", let("canon", "substring(t, instr(t, '|') + 1)", surrogate_sql("p.k", "canon", "a", secret)))
    )
    cased = let("s", made("p.u[i]"), "IF(w = upper(w), upper(s), s)")
    name = f"array_join(transform(split(p.x, ' '), (w, i) -> IF(p.u[i] = '', w, {cased})), ' ')"
    one = f"CASE p.k WHEN '' THEN p.x WHEN 'name' THEN {name} ELSE {layout_sql('p.k', 'p.x', made('p.u[0]'))} END"
    new = F.when(F.col("__none"), F.lit(None).cast("string")).when(F.size("__parts") == 1, F.col("__parts")[0]["x"]).otherwise(
        F.expr(f"array_join(transform(__parts, p -> {one}), '')")
    )
    count = F.size(F.filter("__parts", lambda p: p["k"] != "")).cast("long")
    return parsed.select(*(new.alias(text) if c == text else F.col(f"`{c}`") for c in columns), count.alias("n_entities"))


def _with_redraws(parsed: DataFrame, over: DataFrame, units: Column) -> DataFrame:
    """parsed with __over, by joins: for the texts that hold redrawn entities, a map of these."""
    held_in = F.transform("__parts", lambda p: p["x"])
    keyed = parsed.withColumn("__h1", F.xxhash64(held_in)).withColumn("__h2", F.xxhash64(F.lit(1), held_in))
    held = written(keyed.select("__h1", "__h2", F.explode(units).alias("unit")).distinct(), "held")
    uses = written(held.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).join(over, "unit"), "uses")
    hits = lookup(held, uses, ["unit"], "n", held.count()).groupBy("__h1", "__h2").agg(
        F.map_from_entries(F.collect_list(F.struct("unit", "attempt"))).alias("__over")
    )
    rows = keyed.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__many"))
    hits = written(hits.join(rows, ["__h1", "__h2"]), "redrawn")
    rows = lookup(keyed, hits, ["__h1", "__h2"], "__many", parsed.count(), "left")
    return rows.withColumn("__over", F.coalesce("__over", F.expr("cast(map() as map<string, int>)"))).drop("__h1", "__h2", "__many")


#: Of the query over test data; a user of the operator gives a key of their own.
QUERY_KEY = "the key of op7_pii's own run"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ensure_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="bigint", text="string")
    return pseudonymise(docs, QUERY_KEY).select("doc_id", "text", "n_entities")
