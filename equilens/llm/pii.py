"""Personal data replaced by surrogates, with Spark expressions only.

One pattern with an alternative for each kind of entity cuts a text into entities and what lies between; a plain hint
comes before it, so that texts without any are read once.  An entity consists of units: itself, or given name and
surname.  A unit's canonical form (digits only, lower case, ...) and a key decide its surrogate, so that all mentions
in all documents get the same one: "Mr. Alex Smith" and a later "Mr. Smith" share the surname, "+1 212-555-0188" and
"212-555-0188" the number.  Surrogates keep kind, length, letter case, digits' places, spaces and punctuation; card
numbers and IBANs get valid check digits, cards keep their first digit, IBANs their country, access keys their prefix,
telephone numbers what precedes the last ten digits; addresses of private networks stay in their network, others stay
public; names keep their gender, by title or given name, their script and their parts; mail addresses and hosts end
in a reserved domain.

Collisions are checked over the corpus: where two units of a kind would get one surrogate, or one the form of
a unit that occurs, all but the first try again with the next attempt number until all are distinct.  The forms are
written for that and dropped as soon as it is done; what stays for the result holds keyed hashes of them only.

The key is the caller's secret: who has it can tell which surrogate a known entity has.

Defined results: a card number with a wrong check digit is no entity, nor is a mail address of more than 320 characters; null text stays null, with no entities; equal
entities get equal surrogates wherever they occur; repeated rows are replaced alike; an empty table gives no rows;
existing columns with the outputs' names are replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chat import let
from .common import Tables, without

#: Fixed values by script: consonants and vowels of names, the endings of given names by gender and that of surnames.
LETTERS = {
    "latin": {"consonants": "bdfghklmnprstvwz", "vowels": "aeiou", "given-f": "na", "given-m": "ric", "surname": "n"},
    "cyrillic": {"consonants": "бвгджзклмнпрстфх", "vowels": "аеиоу", "given-f": "на", "given-m": "слав", "surname": "ко"},
}
#: Titles that show a gender, and those that do not.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Госпожа"], "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"], "": ["Dr", "Prof", "Professor", "Doctor"]}
#: Given names that make the following capitalised word a surname, also without a title.
GIVEN = {
    "f": "Alice Amanda Amy Andrea Angela Anna Anne Barbara Carmen Caroline Catherine Charlotte Christine Claire Diana Elena Elizabeth Emily Emma Eva Hannah Helen Ines Isabel Jane Jennifer Jessica Julia Karen "
    "Kate Katharina Laura Linda Lisa Lucia Margaret Maria Marie Martha Mary Monika Nancy Nicole Olivia Patricia Petra Rachel Rebecca Rosa Sandra Sara Sarah Sofia Sophie Susan Teresa Ursula Victoria "
    "Анна Вера Дарья Екатерина Елена Ирина Мария Наталья Нина Ольга Светлана Татьяна",
    "m": "Adam Alexander Andrew Anthony Antonio Benjamin Bernard Carlos Charles Christian Christopher Daniel David Edward Felix Francisco Frank George Hans Henry Hugo Jack Jacques James Javier Jean John Jonas "
    "Jorge Joseph Juan Karl Klaus Louis Lucas Luis Manuel Mark Martin Matthew Michael Miguel Oliver Oscar Pablo Patrick Paul Pedro Peter Philippe Pierre Richard Robert Simon Stefan Steven Thomas William Wolfgang "
    "Александр Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей",
}
_title = "|".join(t for ts in TITLES.values() for t in ts)
_given = "|".join(n for ns in GIVEN.values() for n in ns.split())
_initials = "A-ZА-Я"
_secret = "password|passwd|secret|api_key|apikey|access_token|auth_token"
_prefix = "gh[pousr]_|sk-|xox[abprs]-"
#: Characters of a mail address at most: 64, the sign and 255.
LONGEST_MAIL = 320
#: Kinds and their patterns, the first that matches at a place wins.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)++",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{64}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{32})(?![A-Za-z0-9])",
    "token": rf"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{{36}}|sk-[A-Za-z0-9]{{20,64}}|xox[abprs]-[A-Za-z0-9\-]{{10,80}})(?![A-Za-z0-9_])",
    # After an equals sign any value, after a colon or in quotes one with a digit.
    "password": rf"(?<=[=:\"']|[=:] )(?:(?<=(?i:{_secret})=)|(?<=(?i:{_secret})[\"']?\s{{0,2}}[:=]\s{{0,2}}[\"']?)(?=[A-Za-z+/_\-]{{0,64}}\d))[A-Za-z0-9+/_\-]{{8,}}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ip6": r"(?<![A-Za-z0-9:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{0,4}(?![A-Za-z0-9:]))(?=[0-9A-Fa-f:]{0,37}::)(?=[0-9A-Fa-f:]{0,39}\d)[0-9A-Fa-f:]{2,39})(?![A-Za-z0-9:])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d\-])[2-6]\d{3}(?:[ \-]?\d{4}){3}(?![\d\-])|(?<!\d)3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5}(?!\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{3}[.\-])\d{3}[ .\-]?\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .\-]?\d{2,4}){3,4}(?!\d)",
    "name": rf"(?=[{_initials}])(?<!\p{{L}})(?:(?:{_title})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?|(?:{_given}) \p{{Lu}}\p{{Ll}}+)(?![\p{{L}}])",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Every text with an entity matches one of these.
HINTS = ["[0-9@]", "A[KS]IA[A-Z]{16}", _prefix, "[A-Fa-f]{32}", rf"(?=[{_initials}])(?<!\p{{L}})(?:{_title}|{_given})\.? \p{{Lu}}"]
#: Syllables of a name at the first attempt, of 80 each; every further attempt has one more, so that names never run out.
SYLLABLES = 3
#: Attempts to find a free surrogate.
MOST_ATTEMPTS = 30
#: Texts with overridden attempts that are broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 50_000


def characters(text: Column, change: Callable[[Column, Column], Column]) -> Column:
    """``text`` with every character replaced by ``change(character, place)``."""
    return F.array_join(F.transform(F.split(text, ""), change), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum of a number without its last digit."""
    body = F.reverse(F.substring(digits, F.lit(1), F.length(digits) - 1))
    twice = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    values = F.transform(F.split(body, ""), lambda c, i: F.when(i % 2 == 0, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def kind_of(entity: Column) -> Column:
    """Null for what only looks like a card number, since its check digit is wrong, or like a mail address, since it is too long."""
    out = F.lit("name")
    for kind in reversed([k for k in KINDS if k not in ("name", "password")]):
        out = F.when(entity.rlike(rf"^(?:{KINDS[kind]})$"), kind).otherwise(out)
    out = F.when(entity.rlike(rf"^(?:{KINDS['name']})$"), "name").otherwise(F.when(out == "name", "password").otherwise(out))
    digits = F.regexp_replace(entity, r"\D", "")
    valid = let(digits, lambda d: (luhn(d) + F.substring(d, -1, 1).cast("int")) % 10 == 0)
    return let(out, lambda kind: F.when(F.when(kind == "card", valid).when(kind == "email", F.length(entity) <= LONGEST_MAIL).otherwise(True), kind))


def title_of(entity: Column) -> Column:
    return F.regexp_extract(entity, rf"^((?:{_title})\.? )", 1)


def female(entity: Column) -> Column:
    """By the title, else by the given name."""
    title = F.regexp_replace(title_of(entity), r"[. ]", "")
    name = F.substring_index(F.regexp_replace(entity, rf"^(?:{_title})\.? ", ""), " ", 1)
    return F.when(title.isin(TITLES["f"]), True).when(title.isin(TITLES["m"]), False).otherwise(name.isin(GIVEN["f"].split()))


def canonical(kind: Column, entity: Column) -> Column:
    """What mentions of one entity have in common."""
    digits = F.regexp_replace(entity, r"\D", "")
    return (
        F.when(kind.isin("email", "secret", "ip6"), F.lower(entity))
        .when(kind.isin("ssn", "card"), digits)
        .when(kind == "phone", F.substring(digits, -10, 10))
        .when(kind == "iban", F.replace(entity, F.lit(" ")))
        .when(kind == "name", F.lower(F.regexp_replace(entity, rf"^(?:{_title})\.? ", "")))
        .otherwise(entity)
    )


def units(kind: Column, entity: Column) -> Column:
    """Array of (kind, form): a name has given name and surname, or the surname alone; all others are one unit."""
    unit = lambda k, f: F.struct(k.alias("kind"), f.alias("form"))

    def of(form: Column) -> Column:
        surname = unit(F.lit("surname"), F.substring_index(form, " ", -1))
        given = unit(F.when(female(entity), "given-f").otherwise("given-m"), F.substring_index(form, " ", 1))
        name = F.when(form.contains(" "), F.array(given, surname)).otherwise(F.array(surname))
        return F.when(kind == "name", name).otherwise(F.array(unit(kind, form)))

    return let(canonical(kind, entity), of)


def draw(stream: Column, place: Column, below: int) -> Column:
    """The number at a place of a stream of 64 hexadecimal digits."""
    return F.conv(F.substring(stream, place % 59 + 1, F.lit(6)), 16, 10).cast("long") % below


def stream_of(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), form).cast("binary"), 256)


def redrawn(text: Column, stream: Column) -> Column:
    """Letters become letters of the same case, digits digits; the rest stays."""
    pick = lambda s, n: F.substring(F.lit(s), n.cast("int") + 1, F.lit(1))

    def change(c: Column, i: Column) -> Column:
        return (
            F.when(c.rlike("^[0-9]$"), draw(stream, i, 10).cast("string"))
            .when(c.rlike("^[a-z]$"), pick("abcdefghijklmnopqrstuvwxyz", draw(stream, i, 26)))
            .when(c.rlike("^[A-Z]$"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", draw(stream, i, 26)))
            .otherwise(c)
        )

    return characters(text, change)


def from_place(text: Column, place: int) -> Column:
    return F.substring(text, F.lit(place), F.length(text))


def with_check_digit(digits: Column) -> Column:
    """The last digit replaced so that the number passes the Luhn check."""
    return F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), ((10 - luhn(digits) % 10) % 10).cast("string"))


def iban_with_check_digits(country: Column, account: Column) -> Column:
    """The check digits make the number, country and check digits at its end, letters as 10 to 35, 1 modulo 97."""

    def onward(rest: Column, c: Column) -> Column:
        value = F.when(c.rlike("^[0-9]$"), c.try_cast("long")).otherwise(F.ascii(c).cast("long") - 55)
        return F.when(value < 10, rest * 10 + value).otherwise(rest * 100 + value) % 97

    rest = F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0).cast("long"), onward)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def name_of(kind: Column, form: Column, stream: Column, attempt: Column) -> Column:
    """Syllables of the form's script drawn from a stream, one more for each attempt, and the ending of the kind."""

    def of(script: dict[str, str]) -> Column:
        syllables = "".join(c + v for c in script["consonants"] for v in script["vowels"])
        place = lambda i: (draw(stream, i * 6, len(syllables) // 2) * 2 + 1).cast("int")
        drawn = F.transform(F.sequence(F.lit(1), attempt + SYLLABLES), lambda i: F.substring(F.lit(syllables), place(i), F.lit(2)))
        ending = F.when(kind == "given-f", script["given-f"]).when(kind == "given-m", script["given-m"]).otherwise(script["surname"])
        return F.concat(F.array_join(drawn, ""), ending)

    return F.when(form.rlike(r"\p{IsCyrillic}"), of(LETTERS["cyrillic"])).otherwise(of(LETTERS["latin"]))


def address(form: Column, stream: Column) -> Column:
    """In the same private network, or a public address for a public one."""
    octet = lambda i: (draw(stream, F.lit(i * 8), 254) + 1).cast("string")
    first = F.regexp_extract(form, r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.)", 1)
    inner = F.when(first.rlike(r"\..*\."), F.concat(first, octet(2), F.lit("."), octet(3))).otherwise(F.concat(first, octet(1), F.lit("."), octet(2), F.lit("."), octet(3)))
    return F.when(first != "", inner).otherwise(F.concat_ws(".", (draw(stream, F.lit(0), 89) + 11).cast("string"), octet(1), octet(2), octet(3)))


def surrogate_form(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    """The canonical form of a unit's surrogate."""

    def made(stream: Column) -> Column:
        local, host = F.substring_index(form, "@", 1), F.regexp_replace(F.substring_index(form, "@", -1), r"\.[^.]*$", "")
        digits = redrawn(form, stream)
        # Numbers that begin with 2 to 9 go on doing so.
        number = F.when(form.rlike("^[2-9]"), F.concat((draw(stream, F.lit(50), 8) + 2).cast("string"), from_place(digits, 2))).otherwise(digits)
        return (
            F.when(kind == "email", F.concat(redrawn(local, stream), F.lit("@"), redrawn(host, F.reverse(stream)), F.lit(".example")))
            .when(kind == "key", F.concat(F.substring(form, 1, 4), redrawn(from_place(form, 5), stream)))
            .when(kind == "token", let(F.regexp_extract(form, f"^({_prefix})", 1), lambda p: F.concat(p, redrawn(F.substring(form, F.length(p) + 1, F.length(form)), stream))))
            .when(kind == "ip6", in_format(form, stream, "0-9a-f"))
            .when(kind == "secret", F.substring(stream, F.lit(1), F.length(form)))
            .when((kind == "password") & form.rlike("^[0-9a-f]+$") & (F.length(form) <= 64), F.substring(stream, F.lit(1), F.length(form)))
            .when(kind == "ip", address(form, stream))
            .when(kind == "card", with_check_digit(F.concat(F.substring(form, 1, 1), from_place(digits, 2))))
            .when(kind == "iban", iban_with_check_digits(F.substring(form, 1, 2), redrawn(from_place(form, 5), stream)))
            .when(kind == "phone", number)
            .when(kind.isin("ssn", "password"), digits)
            .otherwise(name_of(kind, form, stream, attempt))
        )

    return let(stream_of(kind, form, attempt, key), made)


def in_format(entity: Column, given: Column, places: str) -> Column:
    """``entity`` with the characters of the class ``places`` replaced by those of ``given`` in turn."""
    before = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), f"[^{places}]", ""))
    return characters(entity, lambda c, i: F.when(c.rlike(f"^[{places}]$"), F.substring(given, before(i) + 1, F.lit(1))).otherwise(c))


def in_case(entity: Column, lower: Column) -> Column:
    """``lower`` in the case of ``entity``, character by character where that is mixed."""
    mixed = characters(lower, lambda c, i: F.when(F.substring(entity, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c))
    return F.when(entity == F.lower(entity), lower).when(entity == F.upper(entity), F.upper(lower)).otherwise(mixed)


def surrogate(kind: Column, entity: Column, attempts: Column, key: str) -> Column:
    """The surrogate in the form of the entity. attempts: one number for each of its units."""

    def of(forms: Column) -> Column:
        first, last = forms[0], F.element_at(forms, -1)
        all_digits = F.regexp_replace(entity, r"\D", "")
        number = F.concat(F.substring(all_digits, F.lit(1), F.greatest(F.length(all_digits) - 10, F.lit(0))), first)
        return (
            F.when(kind.isin("email", "secret", "ip6"), in_case(entity, first))
            .when(kind.isin("ssn", "card"), in_format(entity, first, "0-9"))
            .when(kind == "phone", in_format(entity, number, "0-9"))
            .when(kind == "iban", in_format(entity, first, "A-Z0-9"))
            .when(kind == "name", F.concat(title_of(entity), F.array_join(F.transform(forms, F.initcap), " ")))
            .otherwise(last)
        )

    return let(F.zip_with(units(kind, entity), attempts, lambda u, n: surrogate_form(u["kind"], u["form"], n, key)), of)


def mention(kind: Column, form: Column, key: str) -> Column:
    """A keyed hash that stands for a unit."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, form).cast("binary"), 256)


def overridden(found: DataFrame, key: str, tables: Tables) -> DataFrame:
    """(mention, attempt) of those units that cannot have their first surrogate. found: (kind, form).

    The forms, which are clear text, are dropped however this ends.
    """
    try:
        return _overridden(found, key, tables)
    finally:
        tables.drop("forms", "attempts")


def _overridden(found: DataFrame, key: str, tables: Tables) -> DataFrame:
    known = tables.write(found.distinct(), "forms")
    now = known.withColumn("attempt", F.lit(0))
    for _ in range(MOST_ATTEMPTS):
        tried = now.withColumn("given", surrogate_form(F.col("kind"), F.col("form"), F.col("attempt"), key))
        # The lowest attempt keeps a surrogate, so that whoever has one is not asked again.
        rivals = Window.partitionBy("kind", "given").orderBy("attempt", "form")
        judged = tried.withColumn("again", F.row_number().over(rivals) > 1)
        real = known.select("kind", F.col("form").alias("given"), F.lit(True).alias("real"))
        judged = judged.join(real, ["kind", "given"], "left").select("kind", "form", "attempt", (F.col("again") | F.coalesce("real", F.lit(False))).alias("again"))
        judged = tables.write(judged, "attempts")
        if not judged.where("again").limit(1).count():
            break
        now = judged.select("kind", "form", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    else:
        raise RuntimeError("no distinct surrogates; the space of some kind is too small")
    return tables.write(judged.where("attempt > 0").select(mention(F.col("kind"), F.col("form"), key).alias("mention"), "attempt"), "overrides")


def hinted(text: Column) -> Column:
    """Whether a text may hold an entity, by cheap looks at it."""
    out = (text.contains("=") | text.contains(":")) & text.rlike(rf"(?i:{_secret})[\"']?\s{{0,2}}[:=]")
    for hint in HINTS:
        out = out | text.rlike(hint)
    return out


FOUND = "array<struct<kind:string,entity:string>>"


def entities_of(text: Column) -> Column:
    """Array of (kind, entity) in text order; no text, no entities."""
    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda e: F.struct(kind_of(e).alias("kind"), e.alias("entity")))
    return F.when(hinted(text), found).otherwise(F.array().cast(FOUND))


def replace(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "pii_entities") -> DataFrame:
    """``docs`` with surrogates in ``text_col`` and the replaced entities (kind, entity, surrogate) in ``found_col``."""
    docs, tables = without(docs, found_col, "_entities", "_attempts", "_all", "_text"), Tables(docs.sparkSession, "pii")
    text = docs[text_col]
    hits = docs.select(F.explode(entities_of(text)).alias("e")).select("e.kind", "e.entity").where("kind is not null").distinct()
    overrides = overridden(hits.select(F.explode(units(F.col("kind"), F.col("entity"))).alias("u")).select("u.*"), key, tables)

    none = F.lit(None).cast("map<string,int>")
    if not overrides.limit(1).count():
        found = docs.withColumns({"_entities": entities_of(text), "_attempts": none})
    else:
        # By text: those with an overridden unit get a map of their attempts; texts without entities take no part.
        hashed = F.sha2(text.cast("binary"), 256)
        marked = docs.withColumn("_entities", entities_of(text))
        some = F.size("_entities") > 0
        asked = marked.where(some).select(hashed.alias("_text"), F.explode("_entities").alias("e")).where("e.kind is not null")
        asked = asked.select("_text", F.explode(units(F.col("e.kind"), F.col("e.entity"))).alias("u")).select("_text", mention(F.col("u.kind"), F.col("u.form"), key).alias("mention")).distinct()
        table = tables.write(asked.join(overrides, "mention").groupBy("_text").agg(F.map_from_entries(F.collect_list(F.struct("mention", "attempt"))).alias("_attempts")), "by-text")
        tables.drop("overrides")
        table = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
        found = marked.where(some).withColumn("_text", hashed).join(table, "_text", "left").drop("_text")
        found = found.unionByName(marked.where(~F.coalesce(some, F.lit(False))).withColumn("_attempts", none))

    def of(e: Column) -> Column:
        attempts = F.transform(units(e["kind"], e["entity"]), lambda u: F.coalesce(F.element_at(F.col("_attempts"), mention(u["kind"], u["form"], key)), F.lit(0)))
        return F.struct(e["kind"].alias("kind"), e["entity"].alias("entity"), F.when(e["kind"].isNotNull(), surrogate(e["kind"], e["entity"], attempts, key)).alias("surrogate"))

    found = found.withColumn("_all", F.transform("_entities", of))
    between = F.split(F.col(text_col), ANY, -1)
    put = lambda part, i: F.array(part, F.coalesce(F.get(F.col("_all"), i)["surrogate"], F.get(F.col("_all"), i)["entity"], F.lit("")))
    joined = F.array_join(F.flatten(F.transform(between, put)), "")
    replaced = F.when(F.size("_all") > 0, joined).otherwise(F.col(text_col))
    kept = F.filter("_all", lambda e: e["kind"].isNotNull())
    return found.withColumns({text_col: replaced, found_col: kept}).drop("_entities", "_attempts", "_all")
