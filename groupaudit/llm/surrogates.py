"""Surrogates for personal data, in DataFrame functions only.

1. One pattern finds entities of all kinds in the texts; their distinct values are the entity table.
   A person is found by a title, which tells the gender; given and family names are entities of
   their own, so that "Mrs Anna Weber" and "Mrs Weber" stay the same person.  Where a text names
   them again without a title, also in capitals, they are replaced by the same surrogates; names
   that have a title nowhere in their text are not found.
2. A keyed digest of (kind, value, attempt) gives every value a surrogate of its own kind, format and
   script: digits become digits, letters letters of the same case and script, addresses stay valid,
   a card number's check digit fits as well (or as badly) as before, names fit the gender.
3. A surrogate that another value has taken, or that occurs as a value in the corpus, is drawn again
   with the next attempt, until none is left: distinct values keep distinct surrogates, and one
   value has one surrogate everywhere.
4. Texts are cut at their entities and put together again with the surrogates, so that no surrogate
   is looked at twice.  A text's list of surrogates is joined by the text's digest.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupaudit.llm.common import apart, stored

LENGTHEN = 16  # attempts at a value's own length; later ones grow, so that no format runs out

# fixed values: titles by gender
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Signora", "Госпожа"],
    "m": ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Signor", "Господин"],
    "n": ["Dr", "Prof"],
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ka", "le", "mi", "no", "pa", "re", "si", "to", "va", "ne", "li", "mo"],
    "cyrillic": ["ба", "де", "фи", "го", "ка", "ле", "ми", "но", "па", "ре", "си", "то", "ва", "не", "ли", "мо"],
    "greek": ["βα", "δε", "φι", "γο", "κα", "λε", "μι", "νο", "πα", "ρε", "σι", "το", "θα", "νε", "λι", "μο"],
    "armenian": ["բա", "դե", "ֆի", "գո", "կա", "լե", "մի", "նո", "պա", "րե", "սի", "տո", "վա", "նե", "լի", "մո"],
}
ENDINGS = {
    "latin": {"f": "na", "m": "rt", "n": "l", "s": "nn"}, "cyrillic": {"f": "на", "m": "рт", "n": "л", "s": "нн"},
    "greek": {"f": "να", "m": "ρος", "n": "λ", "s": "ννης"}, "armenian": {"f": "նա", "m": "րտ", "n": "լ", "s": "նն"},
}

_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
EMAIL = r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
SECRET = r"""(?<=(?i:token|secret|password|api[_-]?key)["']?[ ]{0,2}[=:][ ]{0,2}["'])(?!([^"'\s])\1+["'])[^"'\s]{8,}(?=["'])"""
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)"
SOCIAL = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)"
CARD = r"(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w-])"
PERSON = rf"(?<!\p{{L}})(?:{_TITLE})\.? {_NAME}(?: {_NAME})?"
ENTITY = "|".join([EMAIL, SECRET, IBAN, IP, SOCIAL, CARD, PHONE, PERSON])
BARE = r"(?<![\p{L}\p{N}_])\p{Lu}\p{L}+(?:-\p{Lu}\p{L}+)?(?![\p{L}\p{N}_])"  # may be a name without its title
MAYBE = rf"""[0-9@]|(?i:token|secret|password|api)|(?:{_TITLE})\.? \p{{Lu}}"""


def kind_of(value: Column) -> Column:
    """Kind of a found value; ENTITY's order settles what fits two patterns."""
    whole = lambda p: value.rlike(rf"^(?:{p})$")
    return (
        F.when(whole(PERSON), "person")
        .when(whole(EMAIL), "email")
        .when(whole(IBAN), "iban")
        .when(whole(IP), "ip")
        .when(whole(SOCIAL), "social")
        .when(whole(CARD), "card")
        .when(whole(PHONE), "phone")
        .otherwise("secret")
    )


def _gender(value: Column) -> Column:
    title = F.regexp_extract(value, r"^(\p{L}+)", 1)
    return F.when(title.isin(TITLES["f"]), "f").when(title.isin(TITLES["m"]), "m").otherwise("n")


def person_parts(value: Column) -> Column:
    """[title with its dot and space, given name or '', space or '', family name]."""
    names = F.split(F.regexp_replace(value, r"^\p{L}+\.? ", ""), " ")
    two = F.size(names) > 1
    return F.array(
        F.regexp_extract(value, r"^(\p{L}+\.? )", 1),
        F.when(two, names[0]).otherwise(""), F.when(two, " ").otherwise(""), F.when(two, names[1]).otherwise(names[0]),
    )


def _stream(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """Array of bytes from the keyed digest, one for each character of the value at least."""
    block = lambda i: F.unhex(F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), i.cast("string"), value).cast("binary"), 256))
    hexes = F.array_join(F.transform(F.sequence(F.lit(0), (F.length(value) / 32).cast("int")), lambda i: F.hex(block(i))), "")
    return F.transform(F.sequence(F.lit(0), F.length(value)), lambda i: F.conv(F.substr(hexes, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))


# Letters that stand for those of their script; a letter of no script here becomes a Latin one.
SCRIPT_LETTERS = {
    "IsGreek": "αβγδεζηθικλμνξοπρστυφχψω", "IsArmenian": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ",
    "IsHebrew": "אבגדהוזחטיכלמנסעפצקרשת", "IsArabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "IsHan": "天地人日月山水火木金土田中大小上下東西南北", "IsHiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねの",
    "IsKatakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノ", "IsHangul": "가나다라마바사아자차카타파하고노도로모보소오조초코토포호",
}
SIGNS = "!#$%&*+-=?@^_~.:;,/|()[]{}<>"


def _like(c: Column, b: Column, hexes: Column, signs: bool) -> Column:
    """A character of the same class as c, chosen by byte b; signs stay unless they are to change, too."""
    pick = lambda letters: F.substr(F.lit(letters), b % len(letters) + 1, F.lit(1))
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    ascii_ = (
        F.when(c.rlike(r"^\d$"), pick("0123456789"))
        .when(hexes & c.rlike("^[a-f]$"), pick("abcdef"))
        .when(hexes & c.rlike("^[A-F]$"), pick("ABCDEF"))
        .when(c.rlike("^[a-z]$"), pick(low))
        .when(c.rlike("^[A-Z]$"), pick(up))
        .when(c.rlike(r"^[а-я]$"), pick("абвгдежзиклмнопрстуфхцчшщэюя"))
        .when(c.rlike(r"^[А-Я]$"), pick("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"))
    )
    if not signs:
        return ascii_.otherwise(c)
    other = reduce(lambda e, s: e.when(c.rlike(rf"^\p{{{s}}}$"), pick(SCRIPT_LETTERS[s])), SCRIPT_LETTERS, ascii_)
    return other.when(c.rlike(r"^\p{L}$"), pick(low)).otherwise(pick(SIGNS))


def _mapped(value: Column, stream: Column, fixed: Column, hexes: Column | None = None, signs: bool = False) -> Column:
    """Characters of the value mapped, the first ``fixed`` kept."""
    hexes = F.lit(False) if hexes is None else hexes
    at = lambda i: F.substr(value, i + 1, F.lit(1))
    one = lambda i: F.when(i < fixed, at(i)).otherwise(_like(at(i), F.get(stream, i), hexes, signs))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(value) - 1), one), "")


def luhn(digits: Column) -> Column:
    """Check sum modulo 10 of a string of digits."""
    n = F.length(digits)

    def one(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), one), F.lit(0), lambda a, x: a + x) % 10


def _card(value: Column, stream: Column) -> Column:
    new = _mapped(value, stream, F.lit(1))
    head = F.substr(new, F.lit(1), F.length(new) - 1)
    bare = lambda c: F.regexp_replace(c, r"\D", "")
    last = (luhn(bare(value)) - luhn(bare(F.concat(head, F.lit("0")))) + 10) % 10
    return F.concat(head, last.cast("string"))


def _ip(value: Column, stream: Column, attempt: Column) -> Column:
    octets = F.split(value, r"\.")

    def one(o: Column, i: Column) -> Column:
        b = F.get(stream, i)
        same = F.when(F.length(o) == 1, b % 9 + 1).when(F.length(o) == 2, 10 + b % 90).otherwise(100 + b % 156)
        return F.when(attempt < 8, same).otherwise(F.when(i == 0, b % 223 + 1).otherwise(b)).cast("string")

    return F.array_join(F.transform(octets, one), ".")


def _email(value: Column, stream: Column) -> Column:
    """Local part and domain mapped, the top-level domain and a reserved example domain kept."""
    kept = F.regexp_extract(value, r"((?:\.example|@example)?\.[A-Za-z]+)$", 1)
    n = F.length(value) - F.length(kept)
    body = F.substr(value, F.lit(1), n)
    return F.concat(_mapped(body, stream, F.lit(0)), kept)


def _name(value: Column, stream: Column, attempt: Column, gender: Column) -> Column:
    """Two syllables, one more with each attempt, and an ending by gender, in the value's script."""

    def build(script: str) -> Column:
        parts = SYLLABLES[script]
        body = F.array_join(F.transform(F.sequence(F.lit(1), 2 + attempt), lambda i: F.get(F.array(*map(F.lit, parts)), F.get(stream, i % F.size(stream)) % len(parts))), "")
        end = reduce(lambda c, g: c.when(gender == g, ENDINGS[script][g]), ENDINGS[script], F.when(F.lit(False), ""))
        return F.initcap(F.concat(body, end))

    others = [script for script in SYLLABLES if script != "latin"]
    return reduce(lambda c, script: c.when(value.rlike(rf"\p{{Is{script.capitalize()}}}"), build(script)), others, F.when(F.lit(False), "")).otherwise(build("latin"))


def draw(kind: Column, value: Column, attempt: Column, s: Column) -> Column:
    """The surrogate of a value at an attempt, from its digest bytes s."""
    country = F.length(F.regexp_extract(value, r"^(\+\d{1,3}(?=[ (.-])|\+\d)?", 1))
    return (
        F.when(kind == "email", _email(value, s))
        .when(kind == "ip", _ip(value, s, attempt))
        .when(kind == "card", _card(value, s))
        .when(kind == "phone", _mapped(value, s, country))
        .when(kind == "iban", _mapped(value, s, F.lit(2)))
        .when(kind == "social", _mapped(value, s, F.lit(0)))
        .when(kind.startswith("name"), _name(value, s, attempt, F.substring(kind, 6, 1)))
        .otherwise(_mapped(value, s, F.lit(0), value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), signs=True))
    )


def surrogate_table(values: DataFrame, *, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value): distinct surrogates, none a value itself."""
    open_, done, taken = values.select("kind", "value"), None, values.select(F.col("value").alias("s"))
    for attempt in count():
        more = max(0, attempt - LENGTHEN + 1)
        longer = F.when(F.col("kind") == "email", F.concat(F.lit("a" * more), "value")).otherwise(F.concat("value", F.lit("0" * more)))
        fixed = (F.col("kind") == "ip") | F.col("kind").startswith("name")  # names grow by themselves
        given = (F.col("kind"), F.when(fixed, F.col("value")).otherwise(longer), F.lit(attempt))
        # the digest is a column of its own, so that it is not computed for every character
        drawn = open_.withColumn("bytes", _stream(key, *given)).withColumn("surrogate", draw(*given, F.col("bytes")))
        winner = drawn.groupBy("surrogate").agg(F.min(F.struct("kind", "value")).alias("w"))
        free = winner.join(taken, F.col("surrogate") == F.col("s"), "left_anti")
        round_ = stored(free.select("w.kind", "w.value", "surrogate"), "surrogates")
        done = round_ if done is None else done.union(round_)
        open_ = stored(open_.join(round_, ["kind", "value"], "left_anti"), "open")
        if open_.isEmpty():
            return done
        taken = taken.union(round_.select(F.col("surrogate").alias("s")))
    raise AssertionError("unreachable")


def entity_values(found: DataFrame) -> DataFrame:
    """Distinct (kind, value) of found strings (value): persons as their names."""
    kinds = found.select("value").distinct().withColumn("kind", kind_of(F.col("value")))
    persons = kinds.where("kind = 'person'").withColumn("p", person_parts(F.col("value"))).withColumn("g", _gender(F.col("value")))
    given = persons.select(F.concat(F.lit("name_"), "g").alias("kind"), F.col("p")[1].alias("value")).where("value <> ''")
    family = persons.select(F.lit("name_s").alias("kind"), F.col("p")[3].alias("value"))
    return kinds.where("kind <> 'person'").select("kind", "value").union(given).union(family).distinct()


def person_surrogates(found: DataFrame, table: DataFrame) -> DataFrame:
    """(value, p, s1, s2) for every distinct found person: its parts, and surrogates of given and family name."""
    kinds = found.select("value").distinct().withColumn("kind", kind_of(F.col("value")))
    p = person_parts(F.col("value"))
    persons = kinds.where("kind = 'person'").select("value", p.alias("p"), F.concat(F.lit("name_"), _gender(F.col("value"))).alias("g"))
    given = table.select(F.col("kind").alias("g"), F.col("value").alias("v1"), F.col("surrogate").alias("s1"))
    family = table.where("kind = 'name_s'").select(F.col("value").alias("v2"), F.col("surrogate").alias("s2"))
    return (
        persons.withColumn("v1", F.col("p")[1]).withColumn("v2", F.col("p")[3])
        .join(given, ["g", "v1"], "left").join(family, "v2")
        .select("value", "p", "s1", "s2")
    )


def found_surrogates(found: DataFrame, table: DataFrame, persons: DataFrame) -> DataFrame:
    """(value, surrogate) for every distinct found string."""
    kinds = found.select("value").distinct().withColumn("kind", kind_of(F.col("value")))
    plain = kinds.join(table, ["kind", "value"]).select("value", "surrogate")
    named = persons.select("value", F.concat(F.col("p")[0], F.coalesce("s1", F.lit("")), F.col("p")[2], "s2").alias("surrogate"))
    return plain.union(named)


def bare_names(each: DataFrame, persons: DataFrame, digest: str) -> DataFrame:
    """(digest, names): surrogates of a text's own given and family names, also in capitals, as a map.

    A word that is both, or a given name of two genders, is what its first place in the text makes it.
    """
    parts = F.explode(F.array(F.struct(F.col("p")[1].alias("v"), F.col("s1").alias("s")), F.struct(F.col("p")[3].alias("v"), F.col("s2").alias("s"))))
    own = each.join(persons, "value").select(digest, "i", parts.alias("n")).where(F.col("n.s").isNotNull() & ~F.col("n.v").rlike(f"^(?:{_TITLE})$"))
    forms = F.explode(F.array(F.col("n"), F.struct(F.upper("n.v").alias("v"), F.upper("n.s").alias("s"))))
    first = own.select(digest, "i", forms.alias("n")).groupBy(digest, "n.v").agg(F.min(F.struct("i", "n.s")).alias("f"))
    return first.groupBy(digest).agg(F.map_from_entries(F.collect_list(F.struct("v", "f.s"))).alias("names"))


def _renamed(piece: Column, names: Column) -> Column:
    """A piece of text without entities, its bare names replaced."""
    words = F.arrays_zip(F.split(piece, BARE, -1).alias("a"), F.regexp_extract_all(piece, F.lit(BARE), F.lit(0)).alias("b"))
    return F.array_join(F.transform(words, lambda w: F.concat(w["a"], F.coalesce(F.try_element_at(names, w["b"]), w["b"], F.lit("")))), "")


def pseudonymise(docs: DataFrame, *, key: str, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with every entity in ``text`` replaced; rows, ids and other columns as they are.

    ``n_chars``, if there is such a column and it held the text's length, holds the new length.  Null
    and empty texts stay; texts without an entity stay as they are; copies of a text get the same
    text.  Columns may have any names.  A secret of one repeated sign (a mask) stays.  An empty table
    stays empty.
    """
    names = docs.columns
    body = F.col(f"`{text}`")
    hash_, list_, names_ = (apart(c, names) for c in ("_text_digest", "_surrogate_list", "_surrogate_names"))
    maybe = F.coalesce(body.rlike(MAYBE), F.lit(False))
    texts = docs.where(maybe).select(body.alias("t"))
    entities = texts.select(F.sha2("t", 256).alias(hash_), F.regexp_extract_all("t", F.lit(ENTITY), F.lit(0)).alias("e"))
    lists = stored(entities.where(F.size("e") > 0).groupBy(hash_).agg(F.first("e").alias("e")), "entities")
    each = lists.select(hash_, F.posexplode("e").alias("i", "value"))
    table = surrogate_table(stored(entity_values(each), "values"), key=key)
    persons = stored(person_surrogates(each, table), "persons")
    pairs = stored(found_surrogates(each, table, persons), "pairs")
    back = (
        each.join(pairs, "value")
        .groupBy(hash_)
        .agg(F.array_sort(F.collect_list(F.struct("i", "surrogate"))).alias("l"))
        .select(hash_, F.col("l.surrogate").alias(list_))
    )
    back = stored(back.join(bare_names(each, persons, hash_).withColumnRenamed("names", names_), hash_, "left"), "lists")
    touched = docs.where(maybe).withColumn(hash_, F.sha2(body, 256)).join(back.hint("merge"), hash_, "left")
    cut = F.split(body, ENTITY, -1)
    cut = F.when(F.col(names_).isNull(), cut).otherwise(F.transform(cut, lambda piece: _renamed(piece, F.col(names_))))
    pieces = F.arrays_zip(cut.alias("a"), F.col(list_).alias("b"))
    new = F.array_join(F.transform(pieces, lambda p: F.concat(p["a"], F.coalesce(p["b"], F.lit("")))), "")
    new = F.when(F.col(list_).isNull(), body).otherwise(new)
    columns = {c: F.col(f"`{c}`") for c in names} | {text: new}
    if n_chars in names:
        old = F.col(f"`{n_chars}`")
        kind = docs.schema[n_chars].dataType
        columns[n_chars] = F.when(old == F.length(body), F.length(new).cast(kind)).otherwise(old)
    changed = touched.select(*[c.alias(n) for n, c in columns.items()])
    return docs.where(~maybe).select(*[F.col(f"`{c}`") for c in names]).union(changed)
