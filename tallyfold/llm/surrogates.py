"""Personal data replaced by surrogates of the same kind, in DataFrame operations only.

One pattern finds the mentions. A mention becomes pieces, each plain text or an entity of one type with a canonical form, so
that one person, number or address is the same entity however it is written. Every different entity gets one surrogate
from a keyed digest: digits for digits, letters for letters of the same script and case, given names of the same gender, addresses in
their own form. Entities whose surrogate another entity has, or that is itself an entity of the corpus, are numbered on and
derived again until there are none, so different entities stay different. From the fifth attempt on the form grows with every attempt,
so there is a free one for any number of entities after few rounds. Only texts with a mention are moved.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.shared import empty, stored

KEY = "surrogates"
#: Attempts at a surrogate of the entity's own form, before the form grows.
SHORT = 4

# Forms of address, given names by gender and script, syllables of made-up surnames.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Госпожа"],
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Господин"],
    "n": ["Dr", "Prof", "Professor", "Доктор"],
}
GIVEN = {
    ("f", "latin"): "Anna Clara Elena Emma Greta Helen Ines Julia Laura Lucia Maria Marta Nora Olivia Paula Rosa Sarah Sofia Teresa Vera".split(),
    ("m", "latin"): "Adam Carlos David Emil Felix Hugo James Jean John Karl Leon Luis Marco Martin Michael Oscar Paul Peter Robert Thomas".split(),
    ("f", "cyrillic"): "Алина Вера Дарья Елена Ирина Любовь Мария Надежда Ольга Татьяна".split(),
    ("m", "cyrillic"): "Алексей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
}
NEUTRAL = {
    "latin": "Alex Andrea Camille Charlie Dominique Eden Jamie Jordan Kim Robin Sam Sasha".split(),
    "cyrillic": "Женя Саша Шура Валя".split(),
}
#: Given names that begin a mention without a form of address, besides those above; names that are common words or places are left out.
KNOWN = {
    "f": (
        "Abigail Agnes Alice Alicia Alison Amanda Amelia Amy Ana Angela Anita Anja Ann Anne Annette Antonia Audrey Barbara Beatrice Bernadette Beth Betty Beverly "
        "Brenda Brigitte Camila Carla Carmen Carol Caroline Catherine Cecilia Celine Chiara Christina Christine Claire Claudia Colleen Cynthia Daniela Danielle "
        "Deborah Debra Denise Diana Diane Donna Doris Dorothy Edith Eleanor Elisabeth Elizabeth Ella Ellen Emily Erica Esther Eva Evelyn Fatima Fiona Francesca Franziska Gabriela "
        "Gabriele Giulia Gloria Hannah Heather Heidi Heike Helena Ingrid Irene Isabel Isabella Jacqueline Jane Janet Janice Jasmine Jennifer Jessica Joan Johanna Josephine "
        "Joyce Judith Judy Julie Karen Katharina Katherine Kathleen Kathryn Katie Kelly Kimberly Kristin Lauren Lena Leonie Linda Lisa Lori Louise Lucy Lydia Magdalena Manuela Margaret "
        "Margarita Marie Marilyn Marion Martha Mary Megan Melanie Melissa Mia Michelle Mildred Monica Monika Nadia Nancy Natalia Natalie Nathalie Nicole Nina Pamela Patricia "
        "Petra Phyllis Pilar Rachel Rebecca Renate Rita Ruth Sabine Samantha Sandra Sara Sharon Sheila Shirley Silvia Simone Sophia Sophie Stefanie Stephanie Susan Susanne "
        "Suzanne Sylvia Tamara Tanya Tiffany Tina Tracy Ursula Valentina Valerie Vanessa Veronica Wendy Yolanda Yvonne "
        "Александра Анастасия Анна Валентина Валерия Вероника Виктория Галина Евгения Екатерина Елизавета Зинаида Ксения Лариса Лидия Людмила Маргарита Марина Наталья Нина Оксана "
        "Полина Светлана София Тамара Юлия"
    ).split(),
    "m": (
        "Aaron Abdul Adrian Ahmed Alan Albert Alberto Alejandro Alexander Alfred Ali Andre Andreas Andrew Andy Anthony Antonio Arnold Arthur Benjamin Bernard Bernd Bernhard Bill Bob "
        "Brandon Brian Bruce Bruno Bryan Carl Charles Christian Christoph Christopher Claude Craig Daniel Dennis Diego Dieter Donald Douglas Dylan Eduardo Edward Edwin Enrique Eric Ernest "
        "Ethan Eugene Fabian Fernando Florian Francesco Francis Francisco Francois François Frank Franz Fred Frederick Friedrich Gary Georg George Gerald Gerhard Giovanni Giuseppe Gordon "
        "Greg Gregory Guillaume Günter Gustav Hans Harold Harry Heinrich Heinz Helmut Henri Henry Herbert Howard Ian Ibrahim Ivan Jack Jacob Jacques Jan Jason Javier Jeff Jeffrey Jeremy "
        "Jerry Jesse Jesus Jim Joachim Joe Joel Johann Johannes Jonas Jonathan Jorge Jose José Joseph Joshua Juan Julian Julien Jürgen Justin Keith Kenneth Kevin Klaus Kurt Kyle Lars "
        "Larry Laurent Lawrence Leonard Liam Lorenzo Louis Lucas Luca Luigi Lukas Manuel Manfred Marc Marcel Marcus Mario Markus Matthew Matthias Maurice Max Maximilian Miguel Mike "
        "Mohamed Mohammed Nathan Nicholas Nicolas Nikolaus Noah Norman Olivier Otto Pablo Patrick Pedro Philip Philipp Philippe Pierre Rafael Ralph Raymond Ricardo Richard Roberto "
        "Roger Roland Ronald Roy Rudolf Russell Ryan Samuel Scott Sean Sebastian Sergio Simon Stefan Stephan Stephen Steve Steven Sven Theodor Theodore Thierry Tim Timothy Tobias Tom "
        "Tony Tyler Uwe Vincent Walter Werner Wilhelm William Wolfgang Xavier Yusuf Zachary "
        "Александр Анатолий Андрей Антон Артём Вадим Валентин Валерий Василий Виталий Владимир Вячеслав Геннадий Георгий Григорий Денис Евгений Егор Игорь Илья Кирилл "
        "Константин Леонид Максим Никита Павел Пётр Роман Семён Станислав Степан Фёдор Юрий Яков"
    ).split(),
    "n": "Alex Andrea Camille Charlie Dominique Jamie Kim Robin Sam Sasha Женя Саша Шура Валя".split(),
}
SYLLABLES = {
    "latin": "bar ben cor dal den fal gar hol kar lan mar nor pel ros sel tan tor val wen wil".split(),
    "cyrillic": "бар вор гал дан зор кар лан мир нор пол рин сал тар фед хол шен".split(),
}
ALPHABETS = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic_upper": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ",
    "cyrillic_lower": "абвгдежзиклмнопрстуфхцчшщэюя",
    "greek_upper": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "greek_lower": "αβγδεζηθικλμνξοπρστυφχψω",
}

_ATOM = r"\p{L}\p{N}._%+\-"
_EMAIL = rf"(?<![{_ATOM}@])[{_ATOM}]++@[\p{{L}}\p{{N}}\-]++(?:\.[\p{{L}}\p{{N}}\-]++)++"
_SECRET_NAME = r"(?i:password|passwd|pwd|passphrase|secret|token|api[_\-]?key|access[_\-]?key)"
_SECRET = rf"(?<![\p{{L}}\p{{N}}]){_SECRET_NAME}[\"']?[ \t]{{0,3}}[=:][ \t]{{0,3}}[\"']?[^\s\"'<>,;]{{6,}}+"
_CODE = (
    r"(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,}+|eyJ[0-9A-Za-z_\-]{8,}+\.[0-9A-Za-z_\-]++(?:\.[0-9A-Za-z_\-]*+)?)(?![\p{L}\p{N}])"
)
_BEARER = r"(?<![\p{L}\p{N}])(?i:bearer)[ \t]{1,3}[0-9A-Za-z._~+/\-]{16,}+=*+"
_IP = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)"
_GROUP = r"[0-9A-Fa-f]{1,4}"
_IP6 = (
    rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?=[A-Fa-f:]*\d)(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}})"
    r"(?![\p{L}\p{N}:]|\.\d)"
)
_SOCIAL = r"(?<![\p{L}\p{N}\-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4})(?![\p{L}\p{N}]|-\d)"
_ACCOUNT = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![\p{L}\p{N}])"
_CARD = r"(?<![\p{L}\p{N}.\-])(?:\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5}|\d{13,19})(?![\p{L}\p{N}]|[.\-]\d)"
_PHONE = (
    r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,5}\)[ .\-]?)?\d{2,5}(?:[ .\-]?\d{2,5}){1,4}"
    r"|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}|0\d{2,4}[ \-/]\d{3,4}[ \-]?\d{3,4})(?![\p{L}\p{N}]|[.\-]\d)"
)
_ALL_TITLES = "|".join(t for ts in TITLES.values() for t in ts)
_GENDERS = {g: sorted({n for (h, _), ns in GIVEN.items() if h == g for n in ns} | set(KNOWN[g])) for g in KNOWN}


def _any_of(names: list[str]) -> str:
    """A pattern of all names, by their first letter, so that most places are left after one character."""
    heads = sorted({n[0] for n in names})
    return "|".join(f"{h}(?:{'|'.join(n[1:] for n in names if n[0] == h)})" for h in heads)


_LISTED = sorted({n for ns in _GENDERS.values() for n in ns})
_ALL_GIVEN = _any_of(sorted({*_LISTED, *(n.upper() for n in _LISTED)}))
# Small words inside surnames.
PARTICLES = "van von der den de del della di da dos du la le ten ter zu bin ibn al".split()
# An apostrophe or hyphen belongs to a name inside it only, and not before a possessive s.
_WORD = r"\p{Lu}(?:\p{L}|['’\-](?=\p{L})(?!s(?!\p{L})))++"
_INITIALS = r"(?:\p{Lu}\. )*+"
_FURTHER = rf"(?: (?:(?:{'|'.join(PARTICLES)}) ){{0,2}}{_INITIALS}{_WORD})"
_NAME = (
    rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?:(?:{_ALL_TITLES})\.? {_INITIALS}(?:(?:{'|'.join(PARTICLES)}) ){{0,2}}{_WORD}{_FURTHER}{{0,3}}"
    rf"|(?:{_ALL_GIVEN})(?![\p{{L}}'’\-]){_FURTHER}{{1,3}})"
)
PATTERN = "|".join([_EMAIL, _SECRET, _BEARER, _CODE, _IP, _IP6, _SOCIAL, _ACCOUNT, _CARD, _PHONE, _NAME])

_PIECES = "array<struct<type: string, text: string>>"


def _piece(kind: Column | str | None, text: Column) -> Column:
    kind = F.lit(kind).cast("string") if kind is None or isinstance(kind, str) else kind
    return F.struct(kind.alias("type"), text.alias("text"))


def _only(kind: str, text: Column) -> Column:
    return F.array(_piece(kind, text))


def _names(mention: Column) -> Column:
    words = F.split(mention, " ")
    title = F.regexp_replace(words[0], r"\.$", "")
    said = reduce(lambda c, g: c.when(title.isin(TITLES[g]), g), "fm", F.when(F.lit(False), ""))
    titled = title.isin([t for ts in TITLES.values() for t in ts])
    plain = lambda w: F.when(w == F.upper(w), F.initcap(F.lower(w))).otherwise(w)
    known = lambda w: reduce(lambda c, g: c.when(plain(w).isin(_GENDERS[g]), g), _GENDERS, F.when(F.lit(False), ""))
    given = lambda w: F.concat(F.lit("given_"), F.coalesce(F.when(titled, said), known(w), F.lit("n")))
    initial = lambda w: w.rlike(r"^\p{Lu}\.$|^\p{Ll}+$")
    full = F.filter(F.slice(words, F.when(titled, 2).otherwise(1), F.size(words)), lambda w: ~initial(w))
    first = lambda w, i: ~F.exists(F.slice(words, F.when(titled, 2).otherwise(1), F.greatest(F.lit(0), i - F.when(titled, 1).otherwise(0))), lambda v: ~initial(v))

    def piece(w: Column, i: Column) -> Column:
        kind = (
            F.when(titled & (i == 0) | w.isin(PARTICLES), F.lit(None).cast("string"))
            .when(initial(w), "initial")
            .when(first(w, i) & ((F.size(full) > 1) | known(w).isNotNull()), given(w))
            .when((i < F.size(words) - 1) & known(w).isNotNull(), given(w))
            .otherwise("surname")
        )
        word = F.array(_piece(kind, w)).cast(_PIECES)
        return F.when(i > 0, F.concat(F.array(_piece(None, F.lit(" "))).cast(_PIECES), word)).otherwise(word)

    return F.flatten(F.transform(words, piece))


def _pieces(mention: Column) -> Column:
    """A mention as plain and private pieces; the first form that fits it whole names its type."""
    whole = lambda p: mention.rlike(f"^(?:{p})$")
    lead = F.regexp_extract(mention, rf"^({_SECRET_NAME}[\"']?[ \t]*[=:][ \t]*[\"']?)", 1)
    bearer = F.regexp_extract(mention, r"^(\w+[ \t]+)", 1)
    country = F.regexp_extract(mention, r"^(\+\d{1,3}[ .\-]?)(?=[(\d])", 1)
    return (
        F.when(whole(_EMAIL), _only("email", mention))
        .when(whole(_SECRET), F.array(_piece(None, lead), _piece("secret", mention.substr(F.length(lead) + 1, F.length(mention)))))
        .when(whole(_BEARER), F.array(_piece(None, bearer), _piece("secret", mention.substr(F.length(bearer) + 1, F.length(mention)))))
        .when(whole(_CODE), F.array(_piece(None, mention.substr(1, 4)), _piece("secret", mention.substr(F.lit(5), F.length(mention)))))
        .when(whole(_IP), _only("ip", mention))
        .when(whole(_IP6), _only("ip6", mention))
        .when(whole(_SOCIAL), _only("number", mention))
        .when(whole(_ACCOUNT), F.array(_piece(None, mention.substr(1, 2)), _piece("account", mention.substr(F.lit(3), F.length(mention)))))
        .when(whole(_CARD), _only("card", mention))
        .when(whole(_PHONE), F.array(_piece(None, country), _piece("number", mention.substr(F.length(country) + 1, F.length(mention)))))
        .otherwise(_names(mention))
    ).cast(_PIECES)


_NUMBERS = ("number", "card", "account")


def canonical(kind: Column, text: Column) -> Column:
    """What the mentions of one entity have in common."""
    return (
        F.when(kind.isin(*_NUMBERS), F.regexp_replace(text, r"[^0-9A-Za-z]", ""))
        .when(kind.isin("secret", "ip"), text)
        .otherwise(F.lower(text))
    )


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _draw(i: Column | int) -> Column:
    return F.xxhash64(F.col("digest"), i if isinstance(i, Column) else F.lit(i))


def _alike(text: Column, offset: int = 0) -> Column:
    """Another text of the same form: each digit or letter by one of its script and case, hexadecimal texts by hexadecimal."""
    hexadecimal = ((F.col("type") == "secret") & text.rlike("^[0-9a-f]*$")) | (F.col("type") == "ip6")

    def char(c: Column, i: Column) -> Column:
        n = _draw(i + offset)
        letters = lambda a: _pick(list(ALPHABETS[a]), n)
        return (
            F.when(hexadecimal & (c != ":"), _pick(list("0123456789abcdef"), n))
            .when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string"))
            .when(c.rlike(r"[\p{IsCyrillic}&&\p{Lu}]"), letters("cyrillic_upper"))
            .when(c.rlike(r"\p{IsCyrillic}"), letters("cyrillic_lower"))
            .when(c.rlike(r"[\p{IsGreek}&&\p{Lu}]"), letters("greek_upper"))
            .when(c.rlike(r"\p{IsGreek}"), letters("greek_lower"))
            .when(c.rlike(r"\p{Lu}"), letters("upper"))
            .when(c.rlike(r"\p{L}"), letters("lower"))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), char), "")


def _checked(digits: Column) -> Column:
    """The digits with the last one such that the weighted digit sum of card numbers is a multiple of ten."""
    front = digits.substr(F.lit(1), F.length(digits) - 1)
    return F.concat(front, F.pmod(-_weighted(F.concat(front, F.lit("0"))), F.lit(10)).cast("string"))


def _weighted(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = c.try_cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _derive(entities: DataFrame, key: str) -> DataFrame:
    """A surrogate, in canonical form, for every entity and its number of earlier attempts."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), "type", "entity", F.col("attempt").cast("string")), 256)
    rows = entities.withColumn("digest", digest)
    # One digit, name part, syllable, letter or octet of any width more by each attempt.
    more = F.greatest(F.lit(0), F.col("attempt") - SHORT + 1).cast("int")
    entity = F.col("entity")
    same_form = F.when(F.col("type").isin("secret", *_NUMBERS), F.concat(entity, F.repeat(F.lit("0"), more)))
    # An address of the long kind has all eight groups once short forms are used up.
    same_form = same_form.when((F.col("type") == "ip6") & (more > 0), F.lit(":".join(["ffff"] * 8)))
    rows = rows.withColumn("alike", _alike(same_form.when(F.col("type") == "email", F.concat(F.repeat(F.lit("a"), more), entity)).otherwise(entity)))
    script = F.when(entity.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")

    def drawn(table: dict[str, list[str]], i: Column | int) -> Column:
        return reduce(lambda c, s: c.when(script == s, _pick(table[s], _draw(i))), table, F.when(F.lit(False), ""))

    def further(table: dict[str, list[str]], first: int) -> Column:
        return F.transform(F.sequence(F.lit(1), more), lambda i: drawn(table, i + (first - 1)))

    def names(table: dict[str, list[str]]) -> Column:
        one = drawn(table, 0)
        return F.when(more > 0, F.array_join(F.concat(F.array(one), further(table, 1)), "-")).otherwise(one)

    def surnames() -> Column:
        one = lambda i: drawn(SYLLABLES, i)
        short = F.concat(one(0), one(1), one(2), F.when(F.col("attempt") >= 2, F.concat(one(3), one(4))).otherwise(""))
        return F.when(more > 0, F.concat(short, F.array_join(further(SYLLABLES, 5), ""))).otherwise(short)

    octet = lambda part, i: (
        F.when(i < more, F.pmod(_draw(i), F.lit(256))).when(F.length(part) == 3, 100 + F.pmod(_draw(i), F.lit(155))).when(F.length(part) == 2, 10 + F.pmod(_draw(i), F.lit(90))).otherwise(1 + F.pmod(_draw(i), F.lit(9)))
    ).cast("string")
    address = F.array_join(F.transform(F.split("entity", r"\."), octet), ".")
    tail = F.regexp_extract("entity", r"(\.[^.]*)$", 1)
    mail = F.concat(F.col("alike").substr(F.lit(1), F.length("alike") - F.length(tail)), tail)
    kind = F.col("type")
    surrogate = (
        F.when(kind == "email", mail)
        .when(kind == "ip", address)
        .when((kind == "card") & (F.pmod(_weighted(entity), F.lit(10)) == 0), _checked(F.col("alike")))
        .when(kind == "given_f", names({s: GIVEN["f", s] for s in SYLLABLES}))
        .when(kind == "given_m", names({s: GIVEN["m", s] for s in SYLLABLES}))
        .when(kind == "given_n", names(NEUTRAL))
        .when(kind == "surname", surnames())
        .otherwise(F.col("alike"))
    )
    return rows.withColumn("surrogate", F.when(kind.startswith("given") | (kind == "surname"), F.lower(surrogate)).otherwise(surrogate)).select("type", "entity", "attempt", "surrogate")


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``type``, ``entity`` -> the same with ``surrogate``: no two entities of a type share one, and none is an entity itself."""
    table = stored(_derive(entities.select("type", "entity").distinct().withColumn("attempt", F.lit(0)), key))
    while True:
        holders = table.groupBy("type", "surrogate").agg(F.min("entity").alias("keeper"), F.count("*").alias("n")).filter("n > 1")
        again = table.join(holders, ["type", "surrogate"]).filter("entity <> keeper").select("type", "entity", "attempt")
        real = table.select("type", F.col("entity").alias("surrogate"))
        taken = table.join(real, ["type", "surrogate"], "left_semi").select("type", "entity", "attempt")
        again = stored(again.unionByName(taken).distinct())
        if empty(again):
            return table.select("type", "entity", "surrogate")
        fresh = _derive(again.withColumn("attempt", F.col("attempt") + 1), key)
        table = stored(table.join(again, ["type", "entity"], "left_anti").unionByName(fresh))


def _render(text: Column, kind: Column, surrogate: Column) -> Column:
    """A surrogate in the form of the mention: its punctuation, its capitals."""
    count = lambda t: F.length(F.regexp_replace(t, r"[^0-9A-Za-z]", ""))
    step = F.aggregate(
        F.split(text, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("next")),
        lambda acc, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(acc["out"], surrogate.substr(acc["next"], F.lit(1))).alias("out"), (acc["next"] + 1).alias("next"))).otherwise(
            F.struct(F.concat(acc["out"], c).alias("out"), acc["next"].alias("next"))
        ),
        lambda acc: F.concat(acc["out"], surrogate.substr(acc["next"], F.length(surrogate))),
    )
    shouted = (F.upper(text) == text) & (count(text) > 1)
    return (
        F.when(kind.isin(*_NUMBERS), step)
        .when(kind.isin("ip", "secret"), surrogate)
        .when(kind == "ip6", F.when(F.upper(text) == text, F.upper(surrogate)).otherwise(surrogate))
        .when(shouted & (F.lower(text) != text), F.upper(surrogate))
        .when(kind == "email", surrogate)
        .otherwise(F.array_join(F.transform(F.split(surrogate, "-"), F.initcap), "-"))
    )


def _initial(text: Column, key: str) -> Column:
    """Another initial, by one keyed cycle through the capitals of each script, so that different ones stay different; any other letter is X."""
    froms, tos = "", ""
    for letters in (ALPHABETS["upper"], ALPHABETS["cyrillic_upper"], ALPHABETS["greek_upper"]):
        cycle = sorted(letters, key=lambda c: hashlib.sha256(f"{key}\x1f{c}".encode()).digest())
        froms, tos = froms + "".join(cycle), tos + "".join(cycle[1:] + cycle[:1])
    changed = F.translate(text, froms, tos)
    return F.when(changed == text, "X.").otherwise(changed)


def _entities(pieces: str) -> Column:
    found = F.filter(pieces, lambda p: p["type"] != "initial")
    return F.array_distinct(F.transform(found, lambda p: F.struct(p["type"].alias("type"), canonical(p["type"], p["text"]).alias("entity"))))


def _surnames(pieces: str) -> Column:
    """A pattern of the surnames of a text that may stand alone elsewhere in it; matches nothing without one. Surnames hold letters, apostrophes and
    hyphens only."""
    found = F.filter(pieces, lambda p: (p["type"] == "surname") & (F.length(p["text"]) > 2))
    names = F.array_distinct(F.transform(found, lambda p: p["text"]))
    return F.when(F.size(names) > 0, F.concat(F.lit(r"(?<![\p{L}\p{N}'’\-])(?:"), F.array_join(names, "|"), F.lit(r")(?=['’]s(?![\p{L}\p{N}])|(?!['’\-]?[\p{L}\p{N}]))")))


def _with_lone_surnames(pieces: str, pattern: str) -> Column:
    """The pieces, plain ones cut at mentions of the text's own surnames."""

    def cut(p: Column) -> Column:
        plain = F.transform(F.split(p["text"], F.col(pattern), -1), lambda t: F.array(_piece(None, t)).cast(_PIECES))
        names = F.transform(F.regexp_extract_all(p["text"], F.col(pattern), F.lit(0)), lambda t: F.array(_piece("surname", t)).cast(_PIECES))
        both = F.zip_with(plain, names, lambda a, b: F.concat(a, F.coalesce(b, F.array().cast(_PIECES))))
        again = p["type"].isNull() & F.col(pattern).isNotNull() & F.rlike(p["text"], F.col(pattern))
        return F.when(again, F.flatten(both)).otherwise(F.array(p))

    return F.flatten(F.transform(pieces, cut))


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The documents with surrogates for personal data in ``text``; all columns, names and rows as before.

    Null and empty texts and texts without a mention stay as they are; texts of any length are read whole. Rows are told apart by their place in a
    stored table, so repeated rows and null ids do no harm."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    private = F.coalesce(F.col("text").rlike(PATTERN), F.lit(False))
    # One run of the pattern marks all mentions; what marks them is made from the text's own hash, so it does not occur in it.
    mark = F.concat(F.lit("\ue000"), F.lower(F.hex(F.xxhash64("text"))), F.lit("\ue001"))
    parts = F.split(F.regexp_replace("text", F.lit(PATTERN), F.concat(mark, F.lit("$0"), mark)), mark, -1)
    # As rows of a generator the parts are formed once; the filter on them would otherwise repeat all steps.
    found = docs.filter("text IS NOT NULL").select(F.struct(*columns).alias("_row"), F.explode(F.array(parts)).alias("_parts")).filter("size(_parts) > 1")
    whole = lambda t: F.array(_piece(None, t)).cast(_PIECES)
    pieces = F.flatten(F.transform("_parts", lambda t, i: F.when(i % 2 == 1, _pieces(t)).otherwise(whole(t))))
    found = found.select("_row", F.explode(F.array(pieces)).alias("pieces")).withColumn("_names", _surnames("pieces"))
    found = found.select("_row", _with_lone_surnames("pieces", "_names").alias("pieces"), F.monotonically_increasing_id().alias("_place"))
    found = stored(found)
    named = stored(found.select("_place", F.explode(_entities("pieces")).alias("e")).select("_place", "e.*"))
    table = assign(named, key)
    own = named.join(table, ["type", "entity"]).groupBy("_place").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "type", "entity"), F.col("surrogate")))).alias("own")
    )
    said = lambda p: F.concat_ws(":", p["type"], canonical(p["type"], p["text"]))
    new = F.array_join(
        F.transform("pieces", lambda p: F.when(p["type"].isNull(), p["text"]).when(p["type"] == "initial", _initial(p["text"], key)).otherwise(_render(p["text"], p["type"], F.col("own")[said(p)]))), ""
    )
    done = found.join(own, "_place", "left").select("_row", new.alias("_text"))
    done = done.select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    return docs.filter(~private).select(*columns).unionByName(done)
