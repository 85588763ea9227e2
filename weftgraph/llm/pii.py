"""Personal data: found entities get keyed surrogates of their own type and format.

Only DataFrame functions: patterns find entities, keyed digests give surrogates, and a table of all
distinct entities of the corpus is checked for collisions, so that distinct entities stay distinct and
no surrogate is a real entity. Where a format has too few surrogates they grow with each further attempt. Equal entities get equal surrogates everywhere (coreference), whatever
their separators or case. A surrogate keeps the kind of each character (digit, case, script), card and
bank account check digits are right, an address keeps its octets' widths. A titled name's given name is
an entity of its own beside the surname, with its title's gender: its surrogate fits that gender, and
different given names stay different.

An entity may be as long as it likes; work is in proportion to its length.

Null texts stay null, texts without entities stay as they are. Texts are read whole. Repeated rows stay
repeated and alike. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

# Patterns of entities (Java regular expressions), titles, names.
# What is repeated without a bound is one class of characters, never a group: matching a group again and again takes the
# matcher's stack, and a page of very many labels would end the JVM.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
ADDRESS = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])"
PHONE = r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
NUMBER = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
MEN, WOMEN, ANY = ["Mr", "Herr", "Monsieur", "Señor"], ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora"], ["Dr", "Prof"]
NAME = rf"(?<![\p{{L}}])(?:{'|'.join(MEN + WOMEN + ANY)})\.? \p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+)?(?!\p{{L}})"
MEN_GIVEN = "Albert Bruno Carlos David Emil Felix Georg Hugo Ivan Jonas Karl Louis Martin Oscar Paul Robert Simon Thomas Victor Walter".split()
WOMEN_GIVEN = "Alice Berta Clara Diana Elena Flora Greta Helena Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sara Teresa Vera".split()
SURNAMES = "Abbott Becker Castro Dumont Engel Fischer Garnier Harper Ibarra Jansen Keller Lambert Moreau Norton Ortega Parker Quinn Renard Schuster Torres Ulrich Vargas Weber Young Zimmer".split()
#: By the script of a name (the letters it begins with; others get the Latin lists): men's, women's, surnames.
NAMES = [
    ("^[\\u0370-\\u03FF\\u1F00-\\u1FFF]", "Αλέξανδρος Βασίλης Γιώργος Δημήτρης Θωμάς Κώστας Λεωνίδας Μιχάλης Νίκος Πέτρος Στέφανος Χρήστος".split(), "Αγγελική Βασιλική Γεωργία Δέσποινα Ελένη Ιωάννα Κατερίνα Μαρία Νίκη Σοφία Φωτεινή Χριστίνα".split(), "Αντωνίου Βλάχος Γεωργίου Δήμου Ζέρβας Ιωάννου Καραγιάννης Λάμπρου Μακρής Νικολάου Οικονόμου Παππάς Ράπτης Σαμαράς".split()),
    ("^[\\u0400-\\u04FF]", "Андрей Борис Виктор Григорий Дмитрий Егор Захар Игорь Кирилл Леонид Михаил Николай Олег Павел Роман Сергей".split(), "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Марина Наталья Ольга Полина Раиса Софья".split(), "Антонов Белов Власов Громов Демидов Ершов Жуков Зайцев Климов Лебедев Морозов Носов Орлов Павлов Романов Соколов Титов Уваров".split()),
    ("", MEN_GIVEN, WOMEN_GIVEN, SURNAMES),
]
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâäçèéêëíîïñóôöùúûü", "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ", "абвгдежзийклмнопрстуфхцчшщыэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]

ENTITY = "|".join([EMAIL, PHONE, ACCOUNT, CARD, ADDRESS, NUMBER, NAME])
#: Attempts in which a surrogate keeps its entity's length, attempts in all, and entities of a task.
FEW, ATTEMPTS, ENTITIES = 3, 60, 4000
#: What any entity has; a text without it is not searched further.
HINT = rf"@|[0-9]{{2}}|[0-9]\.[0-9]|(?<![\p{{L}}])(?:{'|'.join(MEN + WOMEN + ANY)})\.? \p{{Lu}}"


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, "", -1), lambda c: c != "")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column, odd: int) -> Column:
    """The sum of digits from the last, those at places of parity `odd` (from 0) doubled."""
    d = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == odd, F.element_at(F.array(*map(F.lit, [0, 2, 4, 6, 8, 1, 3, 5, 7, 9])), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x)


def _mod97(account: Column) -> Column:
    """The remainder of an account number, letters as 10 to 35, its first four characters last."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(turned), F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)


def kind_of(raw: Column) -> Column:
    """An entity's kind; null for what only looks like one (wrong check digits)."""
    number = _digits(raw)
    title = F.regexp_extract(raw, r"^(\p{L}+)", 1)
    account = F.regexp_replace(raw, " ", "")
    return (
        F.when(F.contains(raw, F.lit("@")), "email")
        .when(title.isin(MEN), "name").when(title.isin(WOMEN), "name").when(title.isin(ANY), "name")
        .when(raw.rlike("^[A-Z]{2}[0-9]{2}"), F.when(_mod97(account) == 1, "account"))
        .when(raw.rlike(r"^[+(]"), "phone")
        .when(raw.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), "address")
        .when(raw.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "number")
        .when(F.length(number).between(13, 19) & (_luhn(number, 1) % 10 == 0), "card")
    )


def norm_of(kind: Column, raw: Column) -> Column:
    """What two mentions of one entity have in common."""
    return F.when(kind == "email", F.lower(raw)).when(kind == "name", F.regexp_extract(raw, r"([\p{L}]+)$", 1)).when(kind == "account", F.regexp_replace(raw, " ", "")).when(kind == "address", raw).otherwise(_digits(raw))


def given_of(kind: Column, raw: Column) -> Column:
    """A titled name's given name behind its title's gender (m, w, or a for any); null if it has none."""
    title, given = F.regexp_extract(raw, r"^(\p{L}+)", 1), F.regexp_extract(raw, r"^\p{L}+\.? (\p{L}+)[ -]\p{L}+$", 1)
    gender = F.when(title.isin(MEN), "m").when(title.isin(WOMEN), "w").otherwise("a")
    return F.when((kind == "name") & (given != ""), F.concat(gender, F.lit("\x1f"), given))


def _key_at(digest: Column, i: Column) -> Column:
    """A number below 65,536 of the digest's hex digits, for place i."""
    return F.conv(F.substr(digest, (i * 3) % 124 + 1, F.lit(4)), 16, 10).cast("int")


def _alike(s: Column, digest: Column) -> Column:
    """s with each letter and digit replaced by one of its kind."""

    def one(c: Column, i: Column) -> Column:
        out = None
        for a in ALPHABETS:
            to = F.substr(F.lit(a), _key_at(digest, i) % len(a) + 1, F.lit(1))
            out = F.when(F.contains(F.lit(a), c), to) if out is None else out.when(F.contains(F.lit(a), c), to)
        return out.otherwise(c)

    return F.array_join(F.transform(_chars(s), one), "")


def surrogate(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """A keyed surrogate of an entity's norm; another for each attempt."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string")), 512)
    like = _alike(norm, digest)
    # Emails: the domain is one of those reserved for examples.
    local, labels = F.substring_index(norm, "@", 1), F.split(F.substring_index(norm, "@", -1), r"\.")
    host = F.array_join(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0))), ".")
    host = F.when(host == "", "").otherwise(F.concat(_alike(host, F.reverse(digest)), F.lit(".")))
    # The local part grows by a letter or digit an attempt, as short ones are soon all taken.
    email = F.concat(_alike(local, digest), F.substr(digest, F.lit(81), attempt), F.lit("@"), host, F.element_at(F.array(*[F.lit(f"example.{x}") for x in ("com", "net", "org")]), _key_at(digest, F.lit(40)) % 3 + 1))
    # Numbers grow after a few attempts.
    more = F.substr(F.translate(digest, "abcdef", "012345"), F.lit(81), F.greatest(attempt - FEW, F.lit(0)))
    # Cards: the first digit stays, the last is the check digit.
    body = F.concat(F.substr(norm, F.lit(1), F.lit(1)), F.substr(like, F.lit(2), F.length(norm) - 2), more)
    card = F.concat(body, ((10 - _luhn(body, 0) % 10) % 10).cast("string"))
    # Accounts: the country stays, two check digits follow.
    rest = F.substr(like, F.lit(5))
    country = F.substr(norm, F.lit(1), F.lit(2))
    account = F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0"), rest)
    # Addresses: each octet keeps its width in the first attempts.
    octet = lambda o, i: F.when(attempt > FEW, _key_at(digest, i) % 255 + 1).when(F.length(o) == 1, _key_at(digest, i) % 9 + 1).when(F.length(o) == 2, _key_at(digest, i) % 90 + 10).otherwise(_key_at(digest, i) % 155 + 100).cast("string")
    address = F.array_join(F.transform(F.split(norm, r"\."), octet), ".")
    # Phones: the country code's first digit stays.
    phone = F.concat(F.substr(norm, F.lit(1), F.lit(1)), F.substr(like, F.lit(2)), more)
    # Names: more parts at each further attempt, as the lists are short.
    def parts(names: list[str]) -> Column:
        part = lambda i: F.element_at(F.array(*map(F.lit, names)), _key_at(digest, i) % len(names) + 1)
        return F.array_join(F.transform(F.sequence(F.lit(0), F.least(attempt, F.lit(30))), part), "-")

    gender, said = F.substring_index(norm, "\x1f", 1), F.substring_index(norm, "\x1f", -1)
    name = given = F.lit(None).cast("string")
    for script, men, women, surnames in reversed(NAMES):
        name = F.when(norm.rlike(script), parts(surnames)).otherwise(name)
        given = F.when(said.rlike(script), F.when(gender == "m", parts(men)).when(gender == "w", parts(women)).otherwise(parts(men + women))).otherwise(given)
    return F.when(kind == "email", email).when(kind == "card", card).when(kind == "account", account).when(kind == "address", address).when(kind == "phone", phone).when(kind == "name", name).when(kind == "given", given).otherwise(F.concat(like, more))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) of distinct (kind, norm), one to one and never a real entity.

    Who shares a surrogate with one of fewer attempts (or a smaller norm), or has one that is a real
    entity, tries again; the others keep theirs. ATTEMPTS in vain are an error.
    """
    real = cut(entities.select("kind", "norm").distinct())
    # Dealt out anew, as a few bytes of entities are much work.
    given = real.repartition(min(20_000, 1 + real.count() // ENTITIES), "kind", "norm").select("kind", "norm", F.lit(-1).alias("attempt"), F.lit(None).cast("string").alias("surrogate"), F.lit(True).alias("again"))
    clash = real.select("kind", F.substring_index("norm", "\x1f", -1).alias("surrogate"), F.lit(True).alias("is_real")).distinct()
    for _ in range(ATTEMPTS):
        attempt = F.col("attempt") + F.col("again").cast("int")
        new = F.when(F.col("again"), surrogate(key, F.col("kind"), F.col("norm"), attempt)).otherwise(F.col("surrogate"))
        given = cut(given.select("kind", "norm", attempt.alias("attempt"), new.alias("surrogate")))
        first = given.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "norm")).alias("m")).select("kind", "surrogate", F.col("m.norm").alias("owner"))
        given = given.join(first, ["kind", "surrogate"]).join(clash, ["kind", "surrogate"], "left")
        given = cut(given.select("kind", "norm", "attempt", "surrogate", ((F.col("owner") != F.col("norm")) | F.coalesce("is_real", F.lit(False))).alias("again")))
        if not given.where("again").limit(1).count():
            return given.select("kind", "norm", "surrogate")
    raise ValueError(f"no distinct surrogates after {ATTEMPTS} attempts")


def _refill(raw: Column, chars: Column, which: str) -> Column:
    """raw with the characters of kind `which` replaced, in order, by those of `chars`; what is left of these comes last."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))
    step = lambda a, c: F.when(c.rlike(which), F.struct(F.concat(a["out"], F.substr(chars, a["i"], F.lit(1))).alias("out"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i")))
    return F.aggregate(_chars(raw), start, step, lambda a: F.concat(a["out"], F.substr(chars, a["i"])))


def written(kind: Column, raw: Column, new: Column, given: Column) -> Column:
    """A surrogate in the format of the mention it stands for; given is the given name's, or null."""
    title = F.regexp_extract(raw, r"^(\p{L}+\.? )", 1)
    first = F.when(given.isNull(), "").otherwise(F.concat(given, F.regexp_extract(raw, r"([ -])\p{L}+$", 1)))
    return (
        F.when(kind == "name", F.concat(title, first, new))
        .when(kind == "email", F.when((raw == F.upper(raw)), F.upper(new)).otherwise(new))
        .when(kind == "address", new)
        .when(kind == "account", _refill(raw, new, "[A-Z0-9]"))
        .otherwise(_refill(raw, new, "[0-9]"))
    )


def found(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", counted: str = "n_surrogates") -> DataFrame:
    """docs with surrogates in `text`, and their number in `counted` (a column of this name is replaced).

    Mentions, without texts, are kept once; the distinct entities get surrogates; only documents that
    have entities are then joined to the surrogates of their mentions, the rest pass without a shuffle.
    """
    docs = docs.drop(counted)
    column, id_of = F.col(text), F.struct(F.xxhash64(text), F.octet_length(text), F.crc32(F.col(text).cast("binary")))
    mentions = docs.select(id_of.alias("id"), F.explode(F.array_distinct(found(column))).alias("raw")).distinct()
    kind = kind_of(F.col("raw"))
    mentions = mentions.withColumn("kind", kind).where("kind is not null")
    mentions = cut(mentions.withColumn("norm", norm_of(F.col("kind"), F.col("raw"))).withColumn("given", given_of(F.col("kind"), F.col("raw"))))
    given = mentions.where("given is not null")
    table = assign(mentions.select("kind", "norm").unionByName(given.select(F.lit("given").alias("kind"), F.col("given").alias("norm"))), key)
    # Equal texts have equal mentions; so a text's hash, length and checksum stand for the row.
    firsts = table.where("kind = 'given'").select(F.col("norm").alias("given"), F.col("surrogate").alias("first"))
    mentions = given.join(firsts, "given").unionByName(mentions.where("given is null").withColumn("first", F.lit(None).cast("string")))
    maps = mentions.join(table, ["kind", "norm"]).withColumn("new", written(F.col("kind"), F.col("raw"), F.col("surrogate"), F.col("first")))
    id_, of, map_, found_ = fresh(docs, "id", "of", "map", "found")
    maps = maps.groupBy(F.col("id").alias(of)).agg(F.map_from_entries(F.collect_list(F.struct("raw", "new"))).alias(map_))
    some = F.size(found(column)) > 0
    with_any = docs.where(some).withColumn(id_, id_of).join(maps, F.col(id_) == F.col(of), "left").withColumn(found_, found(column))
    new_of = F.transform(found_, lambda r: F.coalesce(F.element_at(F.col(map_), r), r))
    pieces = F.split(column, ENTITY, -1)
    joined = F.array_join(F.flatten(F.zip_with(pieces, new_of, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    n = F.size(F.filter(found_, lambda r: F.element_at(F.col(map_), r).isNotNull()))
    done = with_any.withColumns({text: F.when(F.col(map_).isNull(), column).otherwise(joined), counted: F.when(F.col(map_).isNull(), 0).otherwise(n)})
    rest = docs.where(F.coalesce(~some, F.lit(True))).withColumn(counted, F.lit(0))
    return rest.unionByName(done.select(*docs.columns, counted))
