"""Surrogates for personal data and secrets, in DataFrame functions alone.

One pattern, run once over each text, finds e-mail and IP addresses, phone, card
and social-security numbers, access keys, quoted or assigned secrets and names
after a title.  Each distinct entity gets a replacement made from a keyed SHA-256
stream: same kind, same format (groups, letter case, script, length; cards pass
the Luhn test), names by the gender of their title; where a format has too few,
phone numbers, secrets, addresses and names get longer.  An entity is replaced
alike wherever it occurs, also in another format (digits of a phone number, case
of an address or name, a surname with or without a given name or in its Slavic
feminine form), so references stay together; names of three letters or more that
a text has after a title are replaced in all of that text, also where they stand
alone.  Replacements that fall on another replacement or on any real entity of
their kind are drawn again until none does, so distinct entities stay distinct.

Defined cases: a null text stays null, an empty one empty; repeated rows get equal
results, one each; a null id is an id; empty tables give no rows; long texts are
worked on whole; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stash

_TITLES_M = r"Mr|MR|Mister|Herr|Señor|Sr|Monsieur|Signor|Sir|[Гг]осподин|[Гг]-н|Κύριος"
_TITLES_F = r"Mrs|MRS|Ms|MS|Miss|Madam|Frau|Señora|Señorita|Sra|Madame|Mme|Mademoiselle|Mlle|Signora|Lady|[Гг]оспожа|[Гг]-жа|Κυρία"
_TITLES_N = r"Dr|DR|Doctor|Doktor|Dra|Prof|PROF|Professor|[Дд]октор|[Пп]рофессор"
_TITLE = rf"(?=[MHSFLDPгГдДпПΚ])(?:{_TITLES_M}|{_TITLES_F}|{_TITLES_N})\.? "
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
#: with all eight groups, or with :: after a first group of four
IP6 = r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{4}(?::[0-9A-Fa-f]{1,4}){0,5}:(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}]|:[0-9A-Fa-f])"
PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,5}\)|\d{1,5})(?:[ .-]?\d{2,5}){1,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])(?:1[.-])?(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?!\d|[.-]\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
SSN = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
ACCESS_KEY = r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])"
SECRET = r"""(?i:token|secret|password|passwd|key)\s{0,2}[=:]\s{0,2}["']?[A-Za-z0-9_/+-]{12,}"""
NAME = rf"(?<!\p{{L}}){_TITLE}\p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?"
ENTITY = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, ACCESS_KEY, PHONE, SSN, CARD, IP, IP6, NAME))
#: No text without one of these has an entity, and they are cheap to look for.
_HINT = rf"[0-9@]|(?i:token|secret|pass|key)|{_TITLE}"

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LATIN = "àáâãäåçèéêëìíîïñòóôõöùúûüý"
#: letters of other scripts: Java's name of the script, and a range of its letters without gaps
_SCRIPTS = {"Cyrillic": (0x430, 0x44F), "Greek": (0x3B1, 0x3C9), "Armenian": (0x561, 0x586), "Hebrew": (0x5D0, 0x5EA), "Arabic": (0x628, 0x63A), "Devanagari": (0x915, 0x939), "Thai": (0xE01, 0xE2E), "Georgian": (0x10D0, 0x10F0), "Hangul": (0xAC00, 0xAC7F), "Hiragana": (0x3042, 0x3062), "Katakana": (0x30A2, 0x30C2), "Han": (0x4E00, 0x4E7F)}
_SYLLABLES = "ba be bo da de do fa fe ga ge go ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa se so ta te to va ve vo za zo".split()
#: given names by gender, in Latin, Cyrillic and Greek letters
_GIVEN = {
    "given_m": ("adrian bruno cedric dorian emil felix gustav henrik ivar jonas konrad lorenz matteo nils oskar pascal".split(), "антон борис виктор глеб данил егор захар игнат кирилл леонид марк никита олег павел роман семён".split(), "ανδρέας βασίλης γιώργος δημήτρης ηλίας θωμάς κώστας λάμπρος μάρκος νίκος πέτρος σπύρος στέλιος τάσος φώτης χρήστος".split()),
    "given_f": ("agnes berta clara dora elena frida greta hanna ines johanna klara lena marta nora olga paula".split(), "алла белла вера галина дарья ева зоя инна клара лидия мария нина ольга полина раиса софья".split(), "άννα βάσω γεωργία δήμητρα ελένη ζωή ηρώ ιωάννα κατερίνα λένα μαρία νίκη όλγα ράνια σοφία χριστίνα".split()),
    "given_n": ("alex andrea charlie jean jona kay kim luca mika noa quinn rene robin sam sascha toni".split(), "саша женя валя слава шура паша миша никита валентин лёша кира юля тоня гена рома витя".split(), "άλεξ άρης μάριος φώτης κίμων λίνος νίκος όμηρος πάρης ρένος σάββας τάσος φοίβος χάρης ψάλτης ωρίων".split()),
}
_MAX_ROUNDS = 60


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Around each entity a mark is put; marks that a text has itself are written otherwise meanwhile.
_MARK, _ESCAPED = "\u0001", (("\u0002", "\u0002\u0004"), ("\u0001", "\u0002\u0003"))


def pieces(text):
    """Gaps and entities of a text column in turn: an array that begins and ends with a gap."""
    for plain, written in _ESCAPED:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return F.split(F.regexp_replace(text, ENTITY, f"{_MARK}$0{_MARK}"), _MARK, -1)


def _plain(text):
    for plain, written in reversed(_ESCAPED):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _kind(e):
    return (
        F.when(e.rlike(r"^(?i:token|secret|password|passwd|key)\s{0,2}[=:]"), "secret")
        .when(e.rlike(rf"^{_TITLE}\p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?$"), "name")
        .when(e.rlike(r"^[^@]+@[^@]+$"), "email")
        .when(e.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip")
        .when(e.rlike(r"^[0-9A-Fa-f:]+$") & e.contains(":"), "ip")
        .when(e.rlike(r"^(?:\+|\()[\d(]|^(?:1[.-])?(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})$"), "phone")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(r"^AKIA[A-Z0-9]{16}$"), "access_key")
        .when(e.rlike(r"^\d(?:[ -]?\d){12,18}$"), "card")
        .otherwise("secret")
    )


def _units(e, kind):
    """What of an entity is replaced on its own: an array of (kind, value)."""
    unit = lambda k, v: F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), v.alias("value"))
    digits = F.regexp_replace(e, r"\D", "")
    code = F.regexp_extract(e, r"^\+(\d{1,3})", 1)
    words = F.split(F.regexp_replace(e, f"^{_TITLE}", ""), " ")
    woman = e.rlike(rf"^(?:{_TITLES_F})\.? ")
    given = F.when(woman, "given_f").when(e.rlike(rf"^(?:{_TITLES_M})\.? "), "given_m").otherwise("given_n")
    surname = F.lower(F.element_at(words, -1))
    # Иванова is Иванов, Соловская is Соловский
    surname = F.when(woman, F.regexp_replace(F.regexp_replace(surname, "([оеё]в|[иы]н)а$", "$1"), "([сц]к)ая$", "$1ий")).otherwise(surname)
    return (
        F.when(kind == "email", F.array(unit("local", F.lower(e)), unit("domain", F.lower(F.regexp_extract(e, "@(.*)$", 1)))))
        .when(kind == "phone", F.array(unit("phone", F.concat(code, F.lit(":"), F.substr(digits, F.length(code) + 1)))))
        .when(kind.isin("card", "ssn"), F.array(unit(kind, digits)))
        .when((kind == "name") & (F.size(words) == 2), F.array(unit(given, F.lower(words[0])), unit("surname", surname)))
        .when(kind == "name", F.array(unit("surname", surname)))
        .when(kind == "secret", F.array(unit("secret", F.regexp_extract(e, "[A-Za-z0-9_/+-]+$", 0))))
        .when(kind == "ip", F.array(unit("ip", F.lower(e))))
        .otherwise(F.array(unit(kind, e)))
    )


#: the i-th number from 0 to 255 of the stream in column _hex
_BYTE = "cast(conv(substr(_hex, (({i}) % 64) * 2 + 1, 2), 16, 10) as int)"


def _like(value: str, offset: str = "0") -> str:
    """SQL for a text of the same pattern, letter for letter and digit for digit."""
    b = _BYTE.format(i=f"i + {offset}")
    pick = lambda alphabet, n: f"substr('{alphabet}', {b} % {n} + 1, 1)"
    scripts = " ".join(f"WHEN c rlike '\\\\p{{Is{name}}}' THEN {pick(''.join(map(chr, range(low, high + 1))), high - low + 1)}" for name, (low, high) in _SCRIPTS.items())
    return f"""array_join(transform(split({value}, ''), (c, i) -> CASE
        WHEN c rlike '[0-9]' THEN {pick("0123456789", 10)}
        WHEN c rlike '[a-z]' THEN {pick(_LOWER, 26)}
        WHEN c rlike '[A-Z]' THEN {pick(_UPPER, 26)}
        {scripts}
        WHEN c rlike '\\\\p{{L}}' THEN {pick(_LATIN, len(_LATIN))}
        ELSE c END), '')"""


_IS_CYRILLIC, _IS_GREEK = "value rlike '\\\\p{IsCyrillic}'", "value rlike '\\\\p{IsGreek}'"


def _syllables(n: str, scripts: bool = True) -> str:
    b = _BYTE.format(i="j + 7")
    table = "array(" + ", ".join(f"'{s}'" for s in _SYLLABLES) + ")"
    latin = f"array_join(transform(sequence(1, {n}), j -> element_at({table}, {b} % {len(_SYLLABLES)} + 1)), '')"
    if not scripts:
        return latin
    return f"CASE WHEN {_IS_CYRILLIC} THEN translate({latin}, 'abdefgklmnoprstvz', 'абдефгклмнопрствз') WHEN {_IS_GREEK} THEN translate({latin}, 'abdefgklmnoprstvz', 'αβδεφγκλμνοπρστχζ') ELSE {latin} END"


def _drawn() -> str:
    """SQL for the surrogate of (kind, value) in the given round; later rounds have more room."""
    longer = f"IF(round < 4, '', {_syllables('round - 3', False)})"
    more_digits = f"IF(round < 4, '', array_join(transform(sequence(1, round - 3), j -> {_BYTE.format(i='j + 32')} % 10), ''))"
    octet = f"""array_join(transform(split(value, '[.]'), (o, i) -> CASE
        WHEN round >= 8 THEN cast(1 + {_BYTE.format(i='i')} % 254 as string)
        WHEN length(o) = 1 THEN cast(1 + {_BYTE.format(i='i')} % 9 as string)
        WHEN length(o) = 2 THEN cast(10 + {_BYTE.format(i='i')} % 90 as string)
        ELSE cast(100 + {_BYTE.format(i='i')} % 156 as string) END), '.')"""
    groups = f"array_join(transform(split(IF(round < 8, value, regexp_replace(value, '[0-9a-f]+', '0000')), ''), (c, i) -> IF(c = ':', c, substr('0123456789abcdef', {_BYTE.format(i='i')} % 16 + 1, 1))), '')"
    body = f"concat(substr(value, 1, 1), {_like('substr(value, 2, length(value) - 2)')})"
    luhn = f"""aggregate(transform(split({body}, ''), (d, i) -> IF((length(value) - i) % 2 = 0, cast(d as int) * 2 - IF(cast(d as int) > 4, 9, 0), cast(d as int))), 0, (s, d) -> s + d)"""
    pick = lambda names: f"element_at(array({', '.join(_quoted(n) for n in names)}), {_BYTE.format(i=0)} % {len(names)} + 1)"
    given = {k: f"CASE WHEN {_IS_CYRILLIC} THEN {pick(c)} WHEN {_IS_GREEK} THEN {pick(g)} ELSE {pick(l)} END" for k, (l, c, g) in _GIVEN.items()}
    more = f"IF(round < 2, '', {_syllables('round - 1')})"
    return f"""CASE kind
        WHEN 'local' THEN concat({_like("substring_index(value, '@', 1)")}, {longer})
        WHEN 'domain' THEN concat({_like("regexp_replace(value, '[.][^.]*$', '')", "20")}, {longer}, '.example')
        WHEN 'phone' THEN concat(substring_index(value, ':', 1), ':', {_like("substring_index(value, ':', -1)")}, {more_digits})
        WHEN 'card' THEN concat({body}, cast((10 - {luhn} % 10) % 10 as string))
        WHEN 'ssn' THEN {_like("value")}
        WHEN 'ip' THEN IF(value LIKE '%:%', {groups}, {octet})
        WHEN 'access_key' THEN concat('AKIA', {_like("substr(value, 5)")})
        WHEN 'surname' THEN concat({_syllables('2 + round')}, CASE WHEN {_IS_CYRILLIC} THEN 'нов' WHEN {_IS_GREEK} THEN 'νης' ELSE 'ner' END)
        WHEN 'given_m' THEN concat({given['given_m']}, {more})
        WHEN 'given_f' THEN concat({given['given_f']}, {more})
        WHEN 'given_n' THEN concat({given['given_n']}, {more})
        ELSE concat(IF(value rlike '^[0-9a-f]+$', array_join(transform(split(value, ''), (c, i) -> substr('0123456789abcdef', {_BYTE.format(i='i')} % 16 + 1, 1)), ''), {_like("value")}), {longer}) END"""


def surrogates(units: DataFrame, secret_key: str) -> DataFrame:
    """kind, value and surrogate of each distinct unit: no two of a kind alike, none equal to a real one."""
    real = stash(units.distinct(), "units")
    open_, done = real, []
    for draw in range(_MAX_ROUNDS):
        stream = F.concat(*(F.sha2(F.concat_ws("\u0000", F.lit(secret_key), "kind", "value", F.lit(str(draw)), F.lit(part)).cast("binary"), 256) for part in ("a", "b")))
        drawn = open_.withColumn("_hex", stream).withColumn("round", F.lit(draw)).withColumn("surrogate", F.expr(_drawn())).drop("_hex", "round")
        # what a real entity's own unit would read like; for addresses the local part is compared within itself
        shown = real.select("kind", F.when(F.col("kind") == "local", F.substring_index("value", "@", 1)).otherwise(F.col("value")).alias("surrogate"))
        free = drawn.join(shown, ["kind", "surrogate"], "left_anti")
        if done:
            free = free.join(reduce(DataFrame.unionByName, done).select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        kept = stash(free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select("kind", "value", "surrogate"), "surrogates")
        done.append(kept)
        open_ = stash(open_.join(kept.select("kind", "value"), ["kind", "value"], "left_anti"), "open")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
    raise ValueError("a format has fewer surrogates than entities")


def _cased(word: str, new: str) -> str:
    """SQL for a name in the letter case of the word it stands for."""
    return f"IF(length({word}) > 1 AND {word} = upper({word}), upper({new}), initcap({new}))"


def _written(entity: str, kind: str, parts: str, values: str) -> str:
    """SQL for an entity written with its units' surrogates (an array, in the order of the units; and what they stand for)."""
    digits = f"replace({parts}[0], ':', '')"
    filled = f"array_join(transform(split({entity}, ''), (c, i) -> IF(c rlike '[0-9]', substr({digits}, length(regexp_replace(substr({entity}, 1, i + 1), '[^0-9]', '')), 1), c)), '')"
    rest = f"substr({digits}, length(regexp_replace({entity}, '[^0-9]', '')) + 1)"  # a phone number's further digits
    title = f"regexp_extract({entity}, {_quoted('^' + _TITLE)}, 0)"
    word = f"split(substr({entity}, length({title}) + 1), ' ')[i]"
    # a surname that was not written as its unit had a feminine ending
    ended = f"IF({values}[i] <> lower({word}), concat(x, 'а'), x)"
    name = f"array_join(transform({parts}, (x, i) -> {_cased(word, ended)}), ' ')"
    local = f"array_join(transform(split({parts}[0], ''), (c, i) -> IF(substr({entity}, i + 1, 1) rlike '\\\\p{{Lu}}', upper(c), c)), '')"
    return f"""CASE
        WHEN {kind} = 'email' THEN concat({local}, '@', {parts}[1])
        WHEN {kind} = 'name' THEN concat({title}, {name})
        WHEN {kind} IN ('phone', 'card', 'ssn') THEN concat({filled}, {rest})
        WHEN {kind} = 'secret' THEN concat(regexp_replace({entity}, '[A-Za-z0-9_/+-]+$', ''), {parts}[0])
        ELSE {parts}[0] END"""


#: SQL for a gap in which the names of its text (form: as written after a title; new: the surrogate) are replaced too
_ALONE = r"""aggregate(names, g, (t, n) -> regexp_replace(regexp_replace(t,
    concat('(?<!\\p{L})', upper(n.form), '(?!\\p{L})'), upper(n.new)),
    concat('(?<!\\p{L})(?:', n.form, '|', initcap(n.form), ')', IF(n.ends, '(а?)', '()'), '(?!\\p{L})'), concat(initcap(n.new), '$1')))"""


def replace(docs: DataFrame, secret_key: str = "surrogates") -> DataFrame:
    """doc_id, text (with surrogates), n_entities and kinds (array, sorted) of every row."""
    text = F.col("text").cast("string")
    held = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.when(text.rlike(_HINT), pieces(text)).alias("parts"))
    some = F.size("parts") > 1
    held = stash(held.select("rid", "doc_id", F.when(~F.coalesce(some, F.lit(False)), F.col("text")).alias("text"), F.when(some, F.col("parts")).alias("parts")), "pieces")
    touched = held.filter("parts IS NOT NULL").select("rid", "doc_id", "parts")
    each = touched.select("rid", F.posexplode(F.filter("parts", lambda _, i: i % 2 == 1)).alias("at", "entity"))
    known = each.select("entity").distinct().withColumn("kind", _kind(F.col("entity")))
    known = stash(known.withColumn("units", _units(F.col("entity"), F.col("kind"))), "known")
    of_unit = surrogates(known.select(F.explode("units").alias("u")).select("u.kind", "u.value"), secret_key)
    parts = known.select("entity", "kind", F.posexplode("units").alias("no", "u")).join(of_unit.select(F.col("kind").alias("_kind"), "value", "surrogate"), (F.col("u.kind") == F.col("_kind")) & (F.col("u.value") == F.col("value")))
    parts = parts.groupBy("entity", "kind").agg(F.sort_array(F.collect_list(F.struct("no", "surrogate", "value"))).alias("s"))
    parts = parts.select("entity", "kind", F.col("s.surrogate").alias("parts"), F.col("s.value").alias("vals"))
    spelt = F.split(F.regexp_replace("entity", f"^{_TITLE}", ""), " ")
    names = F.zip_with(spelt, "parts", lambda w, n: F.struct(w.alias("form"), n.alias("new"), n.endswith("нов").alias("ends")))
    names = F.when(F.col("kind") == "name", F.filter(names, lambda n: F.length(n["form"]) > 2)).otherwise(F.array().cast("array<struct<form:string,new:string,ends:boolean>>"))
    # Петрова after a title is the feminine form of the surname, which its text may also have in the other form
    names = F.transform(names, lambda n: F.struct(F.when(n["ends"], F.regexp_replace(n["form"], "([оеё]в|[иы]н)а$", "$1")).otherwise(n["form"]).alias("form"), n["new"].alias("new"), n["ends"].alias("ends")))
    written = lean(parts.select("entity", "kind", F.expr(_written("entity", "kind", "parts", "vals")).alias("new"), names.alias("names")), "written")
    texts = each.join(written, "entity").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("s"), F.sort_array(F.collect_set("kind")).alias("kinds"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    # longer forms first, so that none is cut by a shorter one
    texts = texts.select("rid", F.col("s.new").alias("new"), "kinds", F.array_sort(F.transform("names", lambda n: F.struct((-F.length(n["form"])).alias("least"), n["form"].alias("form"), n["new"].alias("new"), n["ends"].alias("ends")))).alias("names"))
    gaps = F.transform(F.filter("parts", lambda _, i: i % 2 == 0), _plain)
    done = touched.withColumn("gaps", gaps).join(texts, "rid").withColumn("gaps", F.expr(f"transform(gaps, g -> IF(size(names) = 0, g, {_ALONE}))"))
    done = done.select("doc_id", F.array_join(F.zip_with("gaps", "new", lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "").alias("text"), F.size("new").cast("long").alias("n_entities"), "kinds")
    clean = held.filter("parts IS NULL")
    return done.union(clean.select("doc_id", "text", F.lit(0).cast("long"), F.array().cast("array<string>")))
