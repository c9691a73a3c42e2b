"""PII surrogates [native]: keyed, type-consistent, collision-checked replacements.

Entities are found by one pattern, told apart by type, and brought to a form in
which mentions of one thing are equal (digits of a number, letters in lower
case, a secret's value wherever it stands), so that mentions corefer across
documents.  A person's name is taken word by word: the first of several words
is a given name, others are family names, and a word that stands alone is what
it is elsewhere in the corpus, so `Mr John Smith` and `Mr Smith` stay related.
A given name behind a title without gender has the gender that the corpus gives
it, and full names that a title introduces anywhere are found without it too.

Each distinct form gets a surrogate drawn from a keyed digest: digits become
digits and letters letters of the same script and case, card numbers keep their
issuer digit and Luhn sum, IBANs their country and a valid check, addresses stay
valid, and given names come from lists of the same gender and script as long as
these last.  Surrogates that two forms of any type share, or that are forms in
the corpus themselves, are drawn again until all are distinct, in the end with
more characters than the form has.  Only forms without a surrogate are drawn and
judged again, never the whole dictionary or the texts.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Draws of a form's own shape; each later draw has a character more than the one before.
MAX_DRAWS = 24
#: Draws that take given names from the lists; later ones make names up.
LIST_DRAWS = 8
#: Draws that are judged together: the first for all forms, then all others of their shape for those that are left.
TURNS = [range(1), range(1, MAX_DRAWS)]

#: Given names by gender and script.
NAMES = {
    ("m", "latin"): "adam albert anton arthur bernd boris bruno carlos conrad david diego emil enzo felix frank georg gustav henri hugo igor ivan jonas karl klaus leo louis marco martin noel oscar otto paul pedro ralf ruben simon stefan thomas victor walter".split(),
    ("f", "latin"): "agnes alma anna astrid berta bianca carmen clara diana dora elena elsa emma frida gloria greta hanna helen ines irene julia karin klara laura linda luisa maria marta nadia nina olga paula petra rita rosa silvia sofia teresa ursula vera".split(),
    ("x", "latin"): "alexis andrea ariel ashley charlie dominique eden jamie jordan kim lee luca morgan nikola noa quinn robin sasha taylor toni".split(),
    ("m", "cyrillic"): "андрей антон борис вадим виктор глеб денис егор иван игорь кирилл лев максим никита олег павел роман сергей тимур юрий".split(),
    ("f", "cyrillic"): "алла анна белла вера галина дарья елена жанна зоя инна ксения лидия мария нина ольга полина раиса софья тамара юлия".split(),
    ("x", "cyrillic"): "валя женя лера паша саша слава тоня шура".split(),
    ("m", "greek"): "ανδρέας βασίλης γιάννης δημήτρης ηλίας θωμάς κώστας λεωνίδας μιχάλης νίκος παύλος σπύρος στέφανος φίλιππος χρήστος".split(),
    ("f", "greek"): "άννα βασιλική γεωργία δέσποινα ελένη ζωή ιωάννα κατερίνα μαρία νίκη όλγα σοφία τασία φωτεινή χρυσά".split(),
    ("x", "greek"): "άλεξ βάλια κίκα νόνη ρένα τόλη".split(),
}
#: Titles, which tell the gender (x: they do not), and those that are titles with a dot only.
TITLES = {
    "m": "Mr Mister Herr Monsieur Señor Don Signor Senhor Господин Κύριος".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Señorita Doña Signora Senhora Госпожа Κυρία".split(),
    "x": "Dr Prof Professor Доктор Δρ".split(),
}
DOTTED = {"m": "M Sr Sig".split(), "f": "Sra Srta Sig.ra".split()}

_WORD = r"[\p{Lu}\p{Lo}][\p{L}\p{M}]*+(?:[-'’]\p{L}[\p{L}\p{M}]*+)*+"


def _one_of(words: list[str]) -> str:
    return "(?:" + "|".join(w.replace(".", r"\.") for w in sorted(words, key=len, reverse=True)) + ")"


_TITLE = r"(?:" + _one_of([t for ts in TITLES.values() for t in ts]) + r"\.?|" + _one_of([t for ts in DOTTED.values() for t in ts]) + r"\.)"
_LOUD = _one_of([t.upper() for ts in TITLES.values() for t in ts]) + r"\.?"
#: What follows a name and is none: generations.
_SUFFIX = r"^(?:Jr|Sr|II|III|IV|VI{0,3}|IX)$"
_SECRET_NAME = r"(?i:password|passwd|token|secret|api_?key)[\"']?\s?[=:]"
_KEY_MARK = r"(?:AKIA|ASIA|gh[pousr]_|sk-)"
TYPES = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    # In quotes anything; without them four characters or more that hold a digit or a sign, or eight of a key's alphabet.
    "assigned": _SECRET_NAME + r"\s?(?:\"[^\"\s]+\"|'[^'\s]+'|(?=[^\s\"'<>,;&]{4})(?=[^\s\"'<>,;&]{0,255}?(?:[0-9]|[@#$%^*~!][A-Za-z0-9]))[^\s\"'<>,;&]*[^\s\"'<>,;&.!?)\]}:]|[\"']?[A-Za-z0-9_/+-]{8,}[\"']?)",
    "key": r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9_-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d.-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{16})(?![\d-]|\.\d)",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d(+])(?:\+\d{1,3}[ .-]?)?\(?\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d(+.-])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.-])\d{3}-\d{3}-\d{4}(?![\d-])|(?<![\d.-])\d{3}\.\d{3}\.\d{4}(?![\d.-])|(?<![\d+.-])(?<!\d )0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}(?![\d-])",
    # In capitals three words at most, as what follows is in capitals too.
    "person": r"(?<![\p{L}\p{N}])(?:" + _TITLE + " " + _WORD + "(?: (?!" + _TITLE + " )" + _WORD + ")*+|" + _LOUD + " " + _WORD + "(?: (?!" + _LOUD + " )" + _WORD + "){0,2}+)",
}
PATTERN = "|".join(f"(?:{p})" for p in TYPES.values())
#: A cheap test that every text with an entity passes.
HINT = r"@|\d[ .)-]?\d|" + _KEY_MARK + "|" + _SECRET_NAME + r"|::|(?:[0-9A-Fa-f]{1,4}:){7}|(?:" + _TITLE + "|" + _LOUD + r") [\p{Lu}\p{Lo}]|[A-Z]{2}\d{2}[ A-Z0-9]"
_VALUE = r"[=:]\s?[\"']?(\S+?)[\"']?$"
#: Names that stand without a title are looked for in runs of capitalised words.
_RUN = r"(?<![\p{L}\p{M}\p{N}])" + _WORD + "(?: " + _WORD + ")++"
#: North American numbers, which are the same with and without their country code.
_NANP = r"^\+1(?:\D*\d){10}$"


def _every(first: int, n: int, step: int = 1) -> str:
    return "".join(chr(first + step * i) for i in range(n))


#: Letters that stand for a letter of the same kind, as (kind, letters); the first kind that fits counts, the last is for scripts without an alphabet here.
ALPHABETS = [
    ("[aeiou]", "aeiou"), ("[a-z]", "bcdfghjklmnpqrstvwxyz"), (r"\p{IsLatin}", "àáâäåçèéêëíîïñóôöøúûüý"),
    ("[αεηιουω]", "αεηιουω"), ("[άέήίόύώ]", "άέήίόύώ"), (r"\p{IsGreek}", "βγδζθκλμνξπρστφχψ"),
    ("[аеиоуыэюя]", "аеиоуыэюя"), (r"\p{IsCyrillic}", "бвгджзклмнпрстфхцчшщ"),
    (r"\p{IsArmenian}", _every(0x561, 38)), (r"\p{IsGeorgian}", _every(0x10D0, 33)), (r"\p{IsHebrew}", _every(0x5D0, 27)), (r"\p{IsArabic}", _every(0x628, 19) + _every(0x641, 8)),
    (r"\p{IsDevanagari}", _every(0x915, 36)), (r"\p{IsThai}", _every(0xE01, 46)), (r"\p{IsHiragana}", _every(0x3042, 40)), (r"\p{IsKatakana}", _every(0x30A2, 40)), (r"\p{IsHangul}", _every(0xAC00, 100, 28)), (r"\p{IsHan}", _every(0x4E10, 100, 7)),
    (r"\p{L}", "bcdfghjklmnpqrstvwxyz"),
]


def type_of(entity: Column) -> Column:
    """The first type, in the order of TYPES, whose pattern the whole entity matches."""
    return F.coalesce(*[F.when(entity.rlike(r"\A(?:" + p + r")\z"), F.lit(t)) for t, p in TYPES.items()])


def check_97(value: Column) -> Column:
    """An IBAN's rest modulo 97 with its head put last; 1 where it is valid."""
    turned = F.split(F.concat(F.substr(value, F.lit(5)), F.substring(value, 1, 4)), "")
    digit = lambda c: c.rlike("^[0-9]$")
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(digit(c), F.pmod(a * 10 + F.when(digit(c), c).otherwise("0").cast("int"), F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))))


def luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string."""
    parts = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def _gender(entity: Column) -> Column:
    title = F.upper(F.regexp_replace(F.substring_index(entity, " ", 1), r"\.$", ""))
    those = lambda g: title.isin([t.upper() for t in TITLES[g] + DOTTED[g]])
    return F.when(those("m"), "m").when(those("f"), "f").otherwise("x")


def found_in(docs: DataFrame) -> DataFrame:
    """doc_id, tid, at, part, prefix, piece, kind, form of each mention in rows with text and tid, as a written table.

    A person has a part for each word of the name and its title as prefix;
    anything else is one part.  kind and form are null for what only looks
    like an IBAN and for what tells a generation, such as Jr or III.
    """
    hit = docs.filter(F.col("text").rlike(HINT)).select("doc_id", "tid", F.posexplode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("at", "entity"))
    typed = hit.withColumn("type", type_of(F.col("entity")))
    person = F.col("type") == "person"
    title = F.regexp_extract("entity", r"^(\S+ )", 1)
    words = F.split(F.substr(F.col("entity"), F.length(title) + 1), " ")
    parts = typed.withColumns({"gender": _gender(F.col("entity")), "words": F.when(person, words).otherwise(F.array("entity")), "prefix": F.when(person, title).otherwise("")})
    named = F.size(F.filter("words", lambda w: ~w.rlike(_SUFFIX)))
    parts = parts.select("doc_id", "tid", "at", "type", "gender", "prefix", named.alias("n"), F.posexplode("words").alias("part", "piece"))
    bare = F.regexp_replace("piece", "[^A-Za-z0-9]", "")
    iban = (check_97(bare) == 1) | bare.rlike(r"^[A-Z]{2}\d+$")
    given = F.concat(F.lit("given-"), "gender")
    kind = (
        F.when(F.col("type").isin("assigned", "key"), "secret")
        .when(F.col("type") == "iban", F.when(iban, "iban"))
        .when(F.col("type") != "person", F.col("type"))
        .when((F.col("part") > 0) & F.col("piece").rlike(_SUFFIX), F.lit(None).cast("string"))
        .when(F.col("n") <= 1, "alone")
        .otherwise(F.when(F.col("part") == 0, given).otherwise("family"))
    )
    form = (
        F.when(F.col("type") == "assigned", F.regexp_extract("piece", _VALUE, 1))
        .when(F.col("type") == "key", F.col("piece"))
        .when(F.col("type") == "iban", bare)
        .when(F.col("piece").rlike(_NANP) & (F.col("type") == "phone"), F.substring(F.regexp_replace("piece", r"\D", ""), 2, 10))
        .when(F.col("type").isin("card", "ssn", "phone"), F.regexp_replace("piece", r"\D", ""))
        .otherwise(F.lower("piece"))
    )
    parts = scratch.written(parts.withColumns({"kind": kind, "form": F.when(kind.isNotNull(), form)}), "pii-mentions")
    # A word that stands alone is a given name if it is one elsewhere, or in the lists, and no family name.
    listed = F.col("form").isin(sorted({n for names in NAMES.values() for n in names}))
    has = lambda g: F.max((F.col("gender") == g) & (F.col("kind") != "family"))
    seen = parts.filter("type = 'person' and kind is not null").groupBy("form").agg(
        F.max(F.col("kind") == "family").alias("is_family"), F.max(F.col("kind").startswith("given-")).alias("is_given"), has("m").alias("is_m"), has("f").alias("is_f")
    )
    seen = scratch.written(seen.withColumnRenamed("form", "s_form"), "pii-names")
    # Where the title tells no gender, the name's other mentions do, if they agree.
    open_ = F.col("kind").isin("alone", "given-x")
    unsure = parts.filter(open_).join(seen, F.col("form") == F.col("s_form"))
    settled = F.when(F.col("gender") != "x", given).when(F.col("is_m") & ~F.col("is_f"), "given-m").when(F.col("is_f") & ~F.col("is_m"), "given-f").otherwise("given-x")
    unsure = unsure.withColumn("kind", F.when((F.col("kind") == "given-x") | ~F.col("is_family") & (F.col("is_given") | listed), settled).otherwise("family"))
    columns = ["doc_id", "tid", "at", "part", "prefix", "piece", "type", "kind", "form"]
    return scratch.written(parts.filter(open_.isNull() | ~open_).select(columns).unionByName(unsure.select(columns)), "pii-parts")


def _number(digest: Column, i: Column | int) -> Column:
    """The i-th byte of a hex digest, which is used from the start again where it ends."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(digest, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))


def _like(char: Column, n: Column, hexadecimal: Column) -> Column:
    """A character of the same kind: digit, or letter of the same script and case; marks and signs stay."""
    low = F.lower(char)
    letter = F.when(hexadecimal & low.between("a", "f"), _pick("abcdef", n))
    for kind, letters in ALPHABETS:
        letter = letter.when(low.rlike(f"^{kind}$"), _pick(letters, n))
    return F.when(char.rlike("^[0-9]$"), _pick("0123456789", n)).when(letter.isNotNull(), F.when(char == low, letter).otherwise(F.upper(letter))).otherwise(char)


def _mapped(value: Column, digest: Column, keep: Column) -> Column:
    """value with each character but the first `keep` replaced by one of its kind; a leading digit that is not 0 stays so."""
    hexadecimal = value.rlike("^[0-9a-f:]+$")
    out = F.transform(
        F.split(value, ""),
        lambda c, i: F.when(i < keep, c).when((i == 0) & c.rlike("^[1-9]$"), _pick("123456789", _number(digest, i))).otherwise(_like(c, _number(digest, i), hexadecimal)),
    )
    return F.array_join(out, "")


def _drawn(table: DataFrame, key: str) -> DataFrame:
    """table (kind, form, draw) with surrogate: the draw-th surrogate of each form, in the form's own shape.

    From MAX_DRAWS on it has more characters, or is an IPv6 address of eight
    groups, so that every form finds one.  Each step is a column, so that no expression holds another many times.
    """
    kind, form, draw = F.col("kind"), F.col("form"), F.col("draw")
    hashed = lambda *parts: F.sha2(F.concat_ws("\x1f", F.lit(key), F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 512)), 512)
    domain = F.substring_index(form, "@", -1)
    body = F.when(kind == "email", F.substring_index(form, "@", 1)).otherwise(form)
    last = F.regexp_extract(body, r"[\p{L}0-9](?=[^\p{L}0-9]*$)", 0)
    more = F.repeat(F.when(last == "", "x").otherwise(last), F.greatest(draw - (MAX_DRAWS - 1), F.lit(0)).cast("int"))
    step = table.withColumns(
        {
            "s_digest": hashed(kind, form, draw.cast("string")),
            "s_body": F.when(kind.isin("ipv4", "ipv6"), form).otherwise(F.concat(body, more)),
            # A key keeps its mark, an IBAN its country; issuer and country code of a number their first digit.
            "s_keep": F.when(kind == "secret", F.length(F.regexp_extract(form, "^" + _KEY_MARK, 0))).when(kind == "iban", 2).when((kind == "card") | ((kind == "phone") & (F.length(form) > 10)), 1).otherwise(0),
            "s_host": F.when((kind == "email") & ~domain.rlike(r"(?:^|\.)example\.(?:com|net|org)$"), F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1)),
        }
    )
    step = step.withColumn("s_host_digest", hashed(F.lit("domain"), domain))
    octet = lambda o, n: F.when(draw >= LIST_DRAWS, F.pmod(n, F.lit(254)) + 1).when(F.length(o) == 1, F.pmod(n, F.lit(9)) + 1).when(F.length(o) == 2, F.pmod(n, F.lit(90)) + 10).otherwise(F.pmod(n, F.lit(155)) + 100)
    step = step.withColumns(
        {
            "s_mapped": _mapped(F.col("s_body"), F.col("s_digest"), F.col("s_keep")),
            "s_host_mapped": _mapped(F.col("s_host"), F.col("s_host_digest"), F.lit(0)),
            "s_octets": F.when(kind == "ipv4", F.transform(F.split(form, r"\."), lambda o, i: octet(o, _number(F.col("s_digest"), i)).cast("string"))),
            "s_script": F.when(form.rlike(r"\p{IsCyrillic}"), "cyrillic").when(form.rlike(r"\p{IsGreek}"), "greek").when(form.rlike(r"\p{IsLatin}"), "latin").otherwise("other"),
        }
    )
    mapped = F.col("s_mapped")
    step = step.withColumns({"s_front": F.substring(mapped, F.lit(1), F.length(mapped) - 1), "s_valid": F.when(kind == "card", F.pmod(luhn(form), F.lit(10)) == 0).when(kind == "iban", check_97(form) == 1)})
    step = step.withColumn(
        "s_check",
        F.when(~F.col("s_valid"), F.lit(None).cast("string"))
        .when(kind == "card", F.pmod(F.lit(10) - F.pmod(luhn(F.concat("s_front", F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))
        .when(kind == "iban", F.lpad((F.lit(98) - check_97(F.concat(F.substring(form, 1, 2), F.lit("00"), F.substr(mapped, F.lit(5))))).cast("string"), 2, "0")),
    )
    given = mapped  # the lists are short, so later draws make names up
    for (gender, script), names in NAMES.items():
        fits = (draw < LIST_DRAWS) & (kind == f"given-{gender}") & (F.col("s_script") == script)
        pick = lambda at: F.element_at(F.array(*[F.lit(n) for n in names]), F.pmod(_number(F.col("s_digest"), at), F.lit(len(names))) + 1)  # noqa: B023, E731
        given = F.when(fits, F.when(F.contains(form, F.lit("-")), F.concat(pick(50), F.lit("-"), pick(51))).otherwise(pick(50))).otherwise(given)
    email = F.concat(mapped, F.lit("@"), F.when(F.col("s_host").isNull(), domain).otherwise(F.concat("s_host_mapped", F.lit("."), F.substring_index(domain, ".", -1))))
    address = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(F.col("s_digest"), i * 4 + 1, F.lit(4))), ":")
    surrogate = (
        F.when(kind.isin("ipv4", "ipv6") & (draw >= MAX_DRAWS), address)
        .when(kind == "email", email)
        .when((kind == "card") & F.col("s_check").isNotNull(), F.concat("s_front", "s_check"))
        .when((kind == "iban") & F.col("s_check").isNotNull(), F.concat(F.substring(form, 1, 2), "s_check", F.substr(mapped, F.lit(5))))
        .when(kind == "ipv4", F.array_join("s_octets", "."))
        .when(kind.startswith("given-"), given)
        .otherwise(mapped)
    )
    return step.select("kind", "form", "draw", surrogate.alias("surrogate"))


def _space(kind: Column) -> Column:
    """Given names may be given names of others in the corpus; everything else is told apart from all forms of all types."""
    return F.when(kind.startswith("given-"), "given").otherwise("other")


def dictionary(forms: DataFrame, key: str) -> DataFrame:
    """kind, form, surrogate: distinct surrogates of distinct forms, none of which is its own form or, but for given names, any form."""
    waiting = scratch.written(forms.select("kind", "form").filter("form is not null").distinct(), "pii-forms")
    taken = scratch.written(waiting.filter(_space(F.col("kind")) == "other").select(F.col("form").alias("surrogate")).distinct(), "pii-taken")
    settled = None
    for turn in itertools.count():
        start = MAX_DRAWS + 4 * (turn - len(TURNS))
        draws = TURNS[turn] if turn < len(TURNS) else range(start, start + 4)
        tried = _drawn(waiting.withColumn("draw", F.explode(F.array(*[F.lit(d) for d in draws]))), key).filter("surrogate <> form")
        tried = scratch.written(tried.withColumn("space", _space(F.col("kind"))), "pii-tried")
        forbidden = taken.withColumn("space", F.lit("other"))
        if settled is not None:
            # Only the part of the dictionary that the few new draws may meet is shuffled.
            forbidden = scratch.split_by_ids(forbidden.unionByName(settled.select("surrogate", _space(F.col("kind")).alias("space"))), tried, "surrogate")[0]
        free = tried.join(forbidden, ["space", "surrogate"], "left_anti")
        won = free.groupBy("space", "surrogate").agg(F.min(F.struct("draw", "kind", "form")).alias("w"))
        own = won.groupBy("w.kind", "w.form").agg(F.min(F.struct("w.draw", "surrogate")).alias("d"))
        own = scratch.written(own.select("kind", "form", F.col("d.surrogate").alias("surrogate")), "pii-settled")
        settled = own if settled is None else settled.unionByName(own)
        waiting, told = scratch.written_with(waiting.join(own, ["kind", "form"], "left_anti"), "pii-waiting", n=F.count(F.lit(1)))
        if not told["n"]:
            return settled


def _in_order(piece: Column, surrogate: Column, kind: str) -> Column:
    """piece with its characters of a kind replaced by those of the surrogate, one after the other; more of them follow it."""
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        own = c.rlike(f"^{kind}$")
        return F.struct(F.concat(s["out"], F.when(own, F.substring(surrogate, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + own.cast("int")).alias("at"))

    return F.aggregate(F.split(piece, ""), state, step, lambda s: F.concat(s["out"], F.substr(surrogate, s["at"])))


def _cased(piece: Column, surrogate: Column) -> Column:
    """surrogate, which is in lower case, with the capitals of piece; one of another length with capitals where a name has them."""
    chars, own = F.split(surrogate, ""), F.split(piece, "")
    upper = (F.upper(piece) == piece) & (F.lower(piece) != piece) & (F.length(piece) > 1)
    each = F.array_join(F.transform(chars, lambda c, i: F.when(F.lower(F.get(own, i)) != F.get(own, i), F.upper(c)).otherwise(c)), "")
    heads = F.array_join(F.transform(chars, lambda c, i: F.when((i == 0) | F.coalesce(F.get(chars, i - 1).rlike("^[-'’]$"), F.lit(False)), F.upper(c)).otherwise(c)), "")
    capital = F.substring(piece, 1, 1) != F.lower(F.substring(piece, 1, 1))
    return F.when(upper, F.upper(surrogate)).when(F.length(piece) == F.length(surrogate), each).when(capital, heads).otherwise(surrogate)


def rendered(type_: Column, piece: Column, surrogate: Column) -> Column:
    """The surrogate in the format of this mention."""
    whole = F.length(F.regexp_extract(piece, _VALUE, 1))
    at = F.length(F.regexp_extract(piece, r"(?s)^(.*?[=:]\s?[\"']?)\S+?[\"']?$", 1))
    return (
        F.when(type_.isin("card", "ssn", "phone"), _in_order(piece, F.when((type_ == "phone") & piece.rlike(_NANP), F.concat(F.lit("1"), surrogate)).otherwise(surrogate), "[0-9]"))
        .when(type_ == "iban", _in_order(piece, surrogate, "[A-Za-z0-9]"))
        .when(type_.isin("email", "person", "ipv6"), _cased(piece, surrogate))
        .when(type_ == "assigned", F.concat(F.substring(piece, F.lit(1), at), surrogate, F.substr(piece, at + whole + 1)))
        .otherwise(surrogate)
    )


def _untitled(rows: DataFrame, persons: DataFrame) -> DataFrame | None:
    """doc_id, tid, names: the full names of persons (forms, surrogates) that stand in a row, as (old, put), long ones first; None without any.

    A name of three words or more is also looked for by its first and last.
    """
    whole = persons.filter(F.size("forms") > 1)
    ends = persons.filter(F.size("forms") > 2).select(*[F.array(F.get(c, F.lit(0)), F.element_at(c, -1)).alias(c) for c in ("forms", "surrogates")])
    known = whole.unionByName(ends).groupBy(F.array_join("forms", " ").alias("name")).agg(F.min("surrogates").alias("surrogates"))
    known, told = scratch.written_with(known, "pii-known", sizes=F.collect_set(F.size("surrogates")))
    if not told["sizes"]:
        return None
    runs = rows.filter(F.col("text").rlike(_RUN)).select("doc_id", "tid", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_RUN), F.lit(0)))).alias("run"))
    words = runs.select("doc_id", "tid", F.split("run", " ").alias("words"), F.explode(F.array(*[F.lit(n) for n in sorted(told["sizes"])])).alias("n")).filter(F.size("words") >= F.col("n"))
    words = words.select("doc_id", "tid", "words", "n", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)).alias("first"))
    old = words.select("doc_id", "tid", F.array_join(F.slice("words", F.col("first"), F.col("n")), " ").alias("old")).withColumn("name", F.lower("old"))
    met = scratch.split_by_ids(old, known, "name")[0].join(known, "name")
    put = F.array_join(F.transform(F.arrays_zip(F.split("old", " ").alias("w"), F.col("surrogates").alias("s")), lambda x: _cased(x["w"], x["s"])), " ")
    names = met.select("doc_id", "tid", F.struct((-F.length("old")).alias("order"), "old", put.alias("put")).alias("name"))
    return names.groupBy("doc_id", "tid").agg(F.array_sort(F.collect_set("name")).alias("names"))


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, n_entities, text of every row, with a surrogate in place of each entity.

    key is secret: who knows it can try forms.  Equal forms get equal
    surrogates in all documents, distinct forms distinct ones, and no
    surrogate but a given name is itself a form in the input.  A null text
    stays null with no entities; repeated rows are replaced alike; an empty
    table gives no rows; other columns are ignored.
    """
    rows = scratch.keyed(docs)
    mentions = found_in(rows)
    table = scratch.written(dictionary(mentions, key), "pii-dictionary").select(F.col("kind").alias("d_kind"), F.col("form").alias("d_form"), "surrogate")
    told = mentions.join(table, (F.col("kind") == F.col("d_kind")) & (F.col("form") == F.col("d_form")), "left")
    put = F.when(F.col("surrogate").isNull(), F.col("piece")).otherwise(rendered(F.col("type"), F.col("piece"), F.col("surrogate")))
    name = F.when(F.col("type") == "person", F.struct("part", "form", "surrogate"))
    told = told.select("doc_id", "tid", "at", "part", "prefix", put.alias("put"), F.col("surrogate").isNotNull().alias("is_entity"), name.alias("name"))
    whole = told.groupBy("doc_id", "tid", "at").agg(
        F.max("prefix").alias("prefix"), F.max("is_entity").alias("is_entity"), F.array_sort(F.collect_set(F.struct("part", "put"))).alias("parts"), F.array_sort(F.collect_set("name")).alias("name")
    )
    whole = scratch.written(whole.select("doc_id", "tid", "at", "is_entity", F.concat("prefix", F.array_join(F.transform("parts", lambda x: x["put"]), " ")).alias("put"), "name"), "pii-whole")
    by_row = whole.groupBy("doc_id", "tid").agg(F.array_sort(F.collect_list(F.struct("at", "put"))).alias("puts"), F.count_if("is_entity").alias("n"))
    by_row = by_row.select("doc_id", "tid", F.transform("puts", lambda x: x["put"]).alias("puts"), "n")
    words = F.filter("name", lambda x: x["surrogate"].isNotNull())
    persons = whole.select(F.transform(words, lambda x: x["form"]).alias("forms"), F.transform(words, lambda x: x["surrogate"]).alias("surrogates"))
    names = _untitled(rows, persons)
    if names is None:
        by_row = by_row.withColumn("names", F.lit(None).cast("array<struct<order:int,old:string,put:string>>"))
    else:
        by_row = by_row.unionByName(names, True).groupBy("doc_id", "tid").agg(*[F.first(c, True).alias(c) for c in ("puts", "n", "names")])
    by_row = scratch.written(by_row.withColumnsRenamed({"doc_id": "p_id", "tid": "p_tid"}), "pii-rows")
    some, clean = scratch.split_by_ids(rows, by_row.select(F.col("p_tid").alias("tid")), "tid")
    joined = some.join(by_row, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("tid") == F.col("p_tid")), "left")
    # Between the entities, names without a title are replaced where they stand as whole words.
    any_name = F.array_join(F.transform("names", lambda x: x["old"]), "|")
    joined = joined.select(
        "doc_id", "text", "n", "puts", F.split("text", PATTERN, -1).alias("gaps"),
        F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}])(?:"), any_name, F.lit(r")(?![\p{L}\p{M}\p{N}])")).alias("any_name"), F.map_from_entries(F.transform("names", lambda x: F.struct(x["old"], x["put"]))).alias("names"),
    )
    hits = lambda gap: F.regexp_extract_all(gap, F.col("any_name"), F.lit(0))
    named = lambda gap: F.array_join(F.zip_with(F.split(gap, F.col("any_name"), -1), hits(gap), lambda x, h: F.concat(x, F.coalesce(F.element_at("names", h), F.lit("")))), "")
    pieces = F.transform("gaps", lambda x, i: F.concat(F.when(F.col("any_name").isNull(), x).otherwise(named(x)), F.coalesce(F.get("puts", i), F.lit(""))))
    more = F.when(F.col("any_name").isNull(), 0).otherwise(F.aggregate("gaps", F.lit(0), lambda n, gap: n + F.size(hits(gap))))
    count = F.coalesce("n", F.lit(0)) + more
    out = joined.select("doc_id", count.cast("bigint").alias("n_entities"), F.when(F.col("puts").isNull() & F.col("any_name").isNull(), F.col("text")).otherwise(F.array_join(pieces, "")).alias("text"))
    return out.unionByName(clean.select("doc_id", F.lit(0).cast("bigint").alias("n_entities"), "text"))
