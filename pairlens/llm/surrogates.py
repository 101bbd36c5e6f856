"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent replacements.

Only DataFrame and SQL functions are used.  One pattern finds e-mail addresses,
telephone, card and social-security numbers, IPv4 addresses, access keys,
hexadecimal secrets, values behind words such as password and token, and names
behind a form of address.  No part of it starts twice within one run of signs, so
the search is linear however long a run is.  In a text that names somebody so, the
words of that name are entities wherever else they stand with a capital, unless
the text has them in small letters too.

Each entity is one unit, a name one unit a word; a unit is its kind and canonical
form, so that "+1 (743) 555-3824" and "+17435553824", or "Mrs Anna Smith", "Anna"
and "Mrs Smith", agree on what they share.  Within a text a word of a name is one
unit, of the gender that any of its forms of address tells.  A unit's payload comes
from a keyed hash: digits for digits (the country code and a card's first digit
and check sum stay), letters for letters in the same case, a name of the same
gender, script and case: syllables for Latin, Cyrillic, Greek and Armenian, its own
letters anew for other scripts.

All distinct units of the corpus meet in one table; payloads that two units
share, or that are themselves real units, are drawn again until there are none.
The table is joined back by unit, once for each distinct text, and texts with
entities are rebuilt from the gaps between entities and the new payloads.

Defined results: null and empty texts, and texts without entities, come back as
they were.  Equal rows give equal rows.  All other columns are kept.  If a
kind's space is exhausted after ``ATTEMPTS`` draws an error is raised rather
than a surrogate shared.  A name that stands in a text without any form of
address, and one that two texts give unlike genders, are not told to be the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import durable, forget, fresh

ATTEMPTS = 40

#: Forms of address, in several languages, by the gender they tell.
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Señora", "Sra", "госпожа", "г-жа", "κυρία", "Κα"]
MALE = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "господин", "г-н", "κύριος", "Κος"]
NEUTRAL = ["Mx", "Dr", "Prof"]

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Signs before the address are part of the entity, so that a run is tried once; labels are at most 63 signs long in any domain.
EMAIL = r"(?<![A-Za-z0-9._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]{1,63}\.){1,24}[A-Za-z]{2,63}"
IP = rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9-])"
PHONE = r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}([-.])[0-9]{3}\1[0-9]{4}(?![0-9.-])"
ACCESS_KEY = r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
HEX = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
#: What stands before a secret: directly, or with blanks and quotes if the value holds a digit.
SECRET_SIGN = r"(?:(?i:password|passwd|pwd|secret|api_key|apikey|token)(?:[=:](?=[^\s\"',;]{6})|[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?(?=[^\s\"',;]{0,200}[0-9])(?=[^\s\"',;]{6})))"
SECRET = SECRET_SIGN + r"[^\s\"',;]{6,}"
ADDRESS = "(?:" + "|".join(FEMALE + MALE + NEUTRAL) + ")"
NAME_WORD = r"\p{Lu}[\p{L}'’-]+"
NAME = rf"(?<![\p{{L}}\p{{N}}]){ADDRESS}\.? {NAME_WORD}(?: {NAME_WORD}){{0,2}}"
ENTITY = "|".join([SECRET, EMAIL, NAME, IP, SSN, ACCESS_KEY, HEX, CARD, PHONE])
#: The same, and every word that may be part of a name.
ENTITY_OR_WORD = ENTITY + rf"|(?<![\p{{L}}\p{{N}}]){NAME_WORD}"
#: No entity lacks all of these; texts that do are not searched.
HINT = r"[0-9@]|[=:][^\s\"',;]{6}|" + ADDRESS
#: Bare words of a name have at least so many letters.
LEAST_LETTERS = 3

#: Syllables of invented names by script; the last one tells the gender.
LATIN = ["ba", "be", "bri", "ca", "ce", "da", "de", "di", "el", "fa", "fe", "ga", "ha", "hel", "is", "jo", "ka", "la", "le", "li", "lo", "ma", "mi", "na", "ni", "o", "pe", "ra", "ri", "ro", "sa", "se", "ta", "te", "ti", "va", "ve", "vi", "ya", "ze"]
CYRILLIC = ["ба", "бе", "ва", "ве", "га", "да", "де", "ди", "за", "зо", "ил", "ка", "ки", "ла", "ле", "ли", "лю", "ма", "ме", "ми", "на", "не", "ни", "о", "па", "по", "ра", "ре", "ри", "ро", "са", "се", "со", "та", "те", "ти", "ту", "фа", "ха", "я"]
GREEK = ["αλ", "βα", "γε", "δα", "δη", "ελ", "ζω", "θε", "ιω", "κα", "κο", "λα", "λε", "λυ", "μα", "με", "μι", "να", "νι", "ξα", "πα", "πε", "ρα", "ρο", "σα", "σο", "τα", "τι", "φα", "φι", "χα", "χρι"]
ARMENIAN = ["ան", "ար", "բա", "գա", "դա", "զա", "թա", "լի", "կա", "հա", "մա", "մե", "նա", "նի", "պա", "ռա", "սա", "սի", "վա", "տա", "րո", "ֆե"]
SYLLABLES = {"Latin": LATIN, "Cyrillic": CYRILLIC, "Greek": GREEK, "Armenian": ARMENIAN}
LAST = {
    "Latin": {"f": "na", "m": "mir", "n": "len", "family": "sson"}, "Cyrillic": {"f": "на", "m": "мир", "n": "лен", "family": "енко"},
    "Greek": {"f": "ια", "m": "ος", "n": "ω", "family": "ίδη"}, "Armenian": {"f": "ուհի", "m": "են", "n": "ի", "family": "յան"},
}
SEPARATOR = "\u0001"


def _kind(entity: Column) -> Column:
    whole = lambda pattern: entity.rlike(f"^(?:{pattern})$")
    return (
        F.when(entity.rlike("^" + SECRET_SIGN), "secret").when(entity.rlike("@"), "email").when(entity.rlike(rf"^{ADDRESS}\.? "), "name").when(whole(OCTET + r"(?:\." + OCTET + "){3}"), "ip")
        .when(whole(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), "ssn").when(whole(r"[0-9](?:[ -]?[0-9]){12,18}"), "card").when(whole(r"[+(0-9][0-9() .-]{6,}"), "phone")
        .when(whole(ACCESS_KEY + "|" + HEX), "secret").when(whole(NAME_WORD), "word").otherwise("secret")
    )


def _digits(entity: Column) -> Column:
    return F.regexp_replace(entity, "[^0-9]", "")


def _name_words(entity: Column) -> Column:
    return F.slice(F.split(entity, " "), F.lit(2), F.size(F.split(entity, " ")) - 1)


def _gender(entity: Column) -> Column:
    return F.when(entity.rlike("^(?:" + "|".join(FEMALE) + r")\.? "), "f").when(entity.rlike("^(?:" + "|".join(MALE) + r")\.? "), "m").otherwise("n")


def _before(entity: Column) -> Column:
    """What an entity begins with that is not its own: a secret's sign, signs before an address."""
    return F.when(entity.rlike("^" + SECRET_SIGN), F.regexp_extract(entity, "^" + SECRET_SIGN, 0)).when(entity.rlike("@"), F.regexp_extract(entity, "^[._%+-]*", 0)).otherwise("")


def _unit(entity: Column, kind: Column) -> Column:
    """The unit of an entity that is no name: kind, separator, canonical form."""
    own = F.substring(entity, F.length(_before(entity)) + 1, F.length(entity))
    canonical = F.when(kind.isin("card", "phone", "ssn"), _digits(entity)).when((kind == "email") | own.rlike(f"^(?:{HEX})$"), F.lower(own)).otherwise(own)
    canonical = F.when((kind == "phone") & entity.startswith("+"), F.concat(F.lit("+"), F.regexp_extract(entity, r"^\+([0-9]{1,3})(?![0-9])|^\+([0-9])", 0).substr(2, 3), F.lit(" "), canonical)).otherwise(canonical)
    return F.concat(kind, F.lit(SEPARATOR), canonical)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used inside."""
    return F.get(F.transform(F.array(value), body), 0)


def _byte(stream: Column, at: Column) -> Column:
    """A number below 256 from a stream of 128 hexadecimal digits, which repeats from the sixty-fourth on."""
    return F.conv(F.substring(stream, (at % 64 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _alike(text: Column, stream: Column) -> Column:
    """Letters for letters, digits for digits, in the same case; other signs stay."""
    letter = lambda n, first: F.char(n % 26 + ord(first))

    def one(sign: Column, n: Column) -> Column:
        return F.when(sign.between("0", "9"), (n % 10).cast("string")).when(sign.between("a", "z"), letter(n, "a")).when(sign.between("A", "Z"), letter(n, "A")).otherwise(sign)

    return _let(stream, lambda held: F.array_join(F.transform(F.split(text, ""), lambda sign, i: one(sign, _byte(held, i))), ""))


def _hexadecimal(text: Column, stream: Column) -> Column:
    return _let(stream, lambda held: F.array_join(F.transform(F.split(text, ""), lambda _, i: F.substring(F.lit("0123456789abcdef"), _byte(held, i) % 16 + 1, F.lit(1))), ""))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string modulo ten."""
    def value(sign: Column, i: Column) -> Column:
        n = sign.cast("int")
        twice = n * 2
        return F.when((F.length(digits) - i) % 2 == 1, n).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, b: a + b) % 10


def _syllable(syllables: list[str], stream: Column):
    pool = F.array(*map(F.lit, syllables))
    return lambda i: F.element_at(pool, _byte(stream, i) % len(syllables) + 1)


def _payload(unit: Column, key: str, attempt: Column) -> Column:
    """What replaces a unit, at this draw."""
    stream_of = lambda text: F.sha2(F.concat(F.lit(key), F.lit(SEPARATOR), text, F.lit(SEPARATOR), attempt.cast("string")).cast("binary"), 512)
    return _let(stream_of(unit), lambda stream: _drawn(F.substring_index(unit, SEPARATOR, 1), F.substring_index(unit, SEPARATOR, -1), key, stream, attempt))


def _drawn(kind: Column, canonical: Column, key: str, stream: Column, attempt: Column) -> Column:
    digits = F.substring_index(canonical, " ", -1)
    start = F.when(kind == "card", 1).otherwise(F.length(F.regexp_replace(F.regexp_extract(canonical, r"^\+[0-9]+ ", 0), "[^0-9]", "")))
    kept = F.concat(F.substring(digits, F.lit(1), start), F.substring(_alike(digits, stream), start + 1, F.length(digits)))
    body = F.substring(kept, F.lit(1), F.length(kept) - 1)
    checked = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))
    number = F.when((kind == "card") & (_luhn(digits) == 0), checked).otherwise(kept)
    octets = F.concat_ws(".", *(((_byte(stream, F.lit(i)) * 256 + _byte(stream, F.lit(i + 8))) % size + low).cast("string") for i, size, low in ((0, 100, 11), (1, 256, 0), (2, 256, 0), (3, 254, 1))))
    domain = F.substring_index(canonical, "@", -1)
    local, end = F.substring_index(canonical, "@", 1), F.substring_index(domain, ".", -1)
    labels = F.substring(domain, F.lit(1), F.length(domain) - F.length(end) - 1)
    # the domain is drawn by itself, and only once, so that neighbours stay neighbours
    email = F.concat(_alike(local, stream), F.lit("@"), _alike(labels, F.sha2(F.concat(F.lit(key + SEPARATOR), domain).cast("binary"), 512)), F.lit("."), end)
    akia = "^AKIA(?=[0-9A-Z]{16}$)"
    secret = F.when(canonical.rlike("^[0-9a-f]{32,64}$"), _hexadecimal(canonical, stream)).otherwise(F.concat(F.regexp_extract(canonical, akia, 0), _alike(F.regexp_replace(canonical, akia, ""), stream)))
    # letters of other scripts are the name's own, drawn anew, one more each time
    name = _let(F.split(canonical, ""), lambda own: F.array_join(F.transform(F.sequence(F.lit(1), F.size(own) + attempt), lambda i: F.element_at(own, _byte(stream, i) % F.size(own) + 1)), ""))
    for script, syllables in SYLLABLES.items():
        parts = F.transform(F.sequence(F.lit(1), attempt + 3), _syllable(syllables, stream))
        ends = F.when(kind == "family", LAST[script]["family"]).when(kind == "f", LAST[script]["f"]).when(kind == "m", LAST[script]["m"]).otherwise(LAST[script]["n"])
        name = F.when(canonical.rlike(rf"\p{{Is{script}}}"), F.concat(F.array_join(parts, ""), ends)).otherwise(name)
    return F.when(kind.isin("card", "phone", "ssn"), number).when(kind == "ip", octets).when(kind == "email", email).when(kind.isin("f", "m", "n", "family"), name).otherwise(secret)


def _rendered(entity: Column, payloads: Column) -> Column:
    """The entity with its units' payloads in its own format."""
    kind, payload = _kind(entity), F.get(payloads, 0)
    fill = F.aggregate(
        F.split(entity, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")),
        lambda acc, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(acc["s"], F.substring(payload, acc["i"], F.lit(1))).alias("s"), (acc["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i"))),
    )["s"]
    cased = lambda w, p: F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(p)).otherwise(F.initcap(p))
    name = F.concat(F.substring_index(entity, " ", 1), F.lit(" "), F.array_join(F.zip_with(_name_words(entity), payloads, cased), " "))
    own = F.substring(entity, F.length(_before(entity)) + 1, F.length(entity))
    capital = (own == F.upper(own)) & ((kind == "email") | own.rlike(f"^(?:{HEX})$"))
    other = F.concat(_before(entity), F.when(capital, F.upper(payload)).otherwise(payload))
    return F.when(kind.isin("card", "phone", "ssn"), fill).when(kind == "name", name).when(kind == "word", cased(entity, payload)).otherwise(other)


def entities(text: Column) -> Column:
    """All entities of a text in order, repeats included; if it names somebody, every word that may be part of a name too."""
    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    found = F.when(F.exists(found, lambda e: e.rlike(rf"^{ADDRESS}\.? ")), F.regexp_extract_all(text, F.lit(ENTITY_OR_WORD), F.lit(0))).otherwise(found)
    return F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<string>"))


def payload_table(units: DataFrame, key: str) -> DataFrame:
    """(unit, payload) for distinct units; no payload is shared within a kind, nor equals a real unit's form."""
    kind = F.substring_index("unit", SEPARATOR, 1)
    form = F.substring_index(F.substring_index("unit", SEPARATOR, -1), " ", -1)
    real = units.select(kind.alias("kind"), form.alias("payload"))
    # drawing is dear and its input small: deal it to all tasks
    units = units.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit")
    held = durable(units.withColumn("attempt", F.lit(0)).withColumn("payload", _payload(F.col("unit"), key, F.col("attempt"))), "payloads")
    for _ in range(ATTEMPTS):
        told = held.withColumn("kind", kind)
        first = told.groupBy("kind", "payload").agg(F.min("unit").alias("unit"), F.count(F.lit(1)).alias("n"))
        shared = told.join(first.where("n > 1").select("kind", "payload", F.col("unit").alias("first")), ["kind", "payload"]).where("unit != first").select("unit")
        known = told.join(real, ["kind", "payload"], "left_semi").select("unit")
        again, old = durable(shared.unionByName(known).distinct(), "draw-again"), held
        if again.isEmpty():
            return held.select("unit", "payload")
        marked = held.join(again.withColumn("again", F.lit(True)), "unit", "left").withColumn("attempt", F.col("attempt") + F.coalesce(F.col("again"), F.lit(False)).cast("int"))
        held = durable(marked.select("unit", "attempt", F.when(F.col("again"), _payload(F.col("unit"), key, F.col("attempt"))).otherwise(F.col("payload")).alias("payload")), "payloads")
        forget(old)
        forget(again)
    raise RuntimeError(f"no distinct surrogates after {ATTEMPTS} draws")


def units_of(entities: DataFrame) -> DataFrame:
    """one, two, pos, upos, unit of all entities (one, two, pos, entity, small); words that no name of the text has give none."""
    spot, kind = ["one", "two", "pos"], _kind(F.col("entity"))
    known = entities.withColumn("kind", kind)
    others = known.where(~F.col("kind").isin("name", "word")).select(*spot, F.lit(0).alias("upos"), _unit(F.col("entity"), F.col("kind")).alias("unit"))
    words = _name_words(F.col("entity"))
    titled = known.where("kind = 'name'").select(*spot, "small", F.size(words).alias("n"), _gender(F.col("entity")).alias("gender"), F.posexplode(words).alias("upos", "word"))
    role = F.when(F.col("upos") == F.col("n") - 1, "family").otherwise(F.col("gender"))
    # one role a word within a text: a told gender goes before none, and that before the family's
    rank = F.struct(F.when(role == "family", 2).when(role == "n", 1).otherwise(0).alias("rank"), role.alias("role"))
    titled = titled.withColumn("lowered", F.lower("word"))
    told = titled.groupBy("one", "two", "lowered").agg(F.min(rank)["role"].alias("role"), F.bool_or(F.array_contains("small", F.col("lowered"))).alias("plain"))
    unit = F.concat("role", F.lit(SEPARATOR), "lowered").alias("unit")
    named = titled.select(*spot, "upos", "lowered").join(told, ["one", "two", "lowered"]).select(*spot, "upos", unit)
    bare = known.where("kind = 'word'").select(*spot, F.lower("entity").alias("lowered")).join(told.where(~F.col("plain") & (F.length("lowered") >= LEAST_LETTERS)), ["one", "two", "lowered"])
    return others.unionByName(named).unionByName(bare.select(*spot, F.lit(0).alias("upos"), unit))


def replace(docs: DataFrame, key: str, *, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; column ``count``, if named, tells how many entities were replaced."""
    taken = list(docs.columns)
    one, two, found, new, times = (fresh(taken, f"_pii_{x}") for x in ("one", "two", "found", "new", "times"))
    none = F.array().cast("array<string>")
    whole = docs.withColumn(found, F.coalesce(entities(F.col(text)), none))
    clean = whole.where(F.size(found) == 0).withColumn(times, F.lit(0).cast("long"))
    rows = durable(whole.where(F.size(found) > 0).withColumn(one, F.xxhash64(text)).withColumn(two, F.xxhash64(F.lit(1), F.col(text))), "pii")
    # words of names that the text also has in small letters
    names = F.flatten(F.transform(F.filter(found, lambda e: e.rlike(rf"^{ADDRESS}\.? ")), lambda e: F.transform(_name_words(e), F.lower)))
    small = F.when(F.size(names) > 0, F.array_intersect(names, F.split(text, r"[^\p{L}'’-]+"))).otherwise(none)
    each = rows.select(F.col(one).alias("one"), F.col(two).alias("two"), F.col(found).alias("found"), small.alias("small")).dropDuplicates(["one", "two"])
    each = durable(each.select("one", "two", "small", F.posexplode("found").alias("pos", "entity")), "pii-entities")
    units = durable(units_of(each), "pii-units")
    payloads = payload_table(durable(units.select("unit").distinct(), "pii-distinct"), key)
    drawn = units.join(payloads, "unit").groupBy("one", "two", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("upos", "payload"))), lambda x: x["payload"]).alias("payloads"))
    shown = each.join(drawn, ["one", "two", "pos"], "left").withColumn("new", F.when(F.col("payloads").isNull(), F.col("entity")).otherwise(_rendered(F.col("entity"), F.col("payloads"))))
    texts = shown.groupBy(F.col("one").alias(one), F.col("two").alias(two)).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias(new), F.count("payloads").alias(times))
    rows = rows.join(texts, [one, two])
    named = F.exists(found, lambda e: e.rlike(rf"^{ADDRESS}\.? "))
    gaps = F.when(named, F.split(F.col(text), ENTITY_OR_WORD, -1)).otherwise(F.split(F.col(text), ENTITY, -1))
    rows = rows.withColumn(text, F.array_join(F.zip_with(gaps, new, lambda g, e: F.concat(g, F.coalesce(e, F.lit("")))), ""))
    out = rows.select(*taken, times).unionByName(clean.select(*taken, times))
    return out.select(*taken, *([F.col(times).alias(count)] if count else []))
