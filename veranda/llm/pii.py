r"""Surrogates for personal data and secrets, by DataFrame functions only.

Entities are found by one regular expression; each distinct (kind, entity) gets one surrogate wherever it occurs, so coreference holds over the
whole corpus, and different entities get different surrogates. A surrogate is made from SHA-256 of key, kind, attempt and entity, and keeps
the form: digits for digits, letters for letters of the same case and script (Latin, accented Latin, Greek, Cyrillic), punctuation as it is. Kinds keep what makes
them valid: the last label of a mail's domain, the range of an IP address's numbers, a phone's country code, a card's first digit
and its check digit, a key's prefix, hexadecimal digits; a name after a title is replaced by a name of the title's gender and the name's script.

Letters and digits of other scripts get Latin letters of their case and digits.

Collision checks: a surrogate that equals any detected entity, or that of another entity, is made anew with the next attempt, until none
collides. A body without letters and digits, and after ROUNDS attempts any other (its form may be full), is given up for a keyed one of 80 bits
or more, so that there is always a free one: letters in a secret, a mail's local part or a name, twenty digits in a phone number,
an IPv6 address for an IP address, further digits behind other numbers; so are bodies of over LONGEST characters. A text is rebuilt from its
pieces between entities, so what is found is what is replaced. A run of 13 to 19 digits is a card only if its check digit is right. Texts without
entities pass where they are read; of the others the distinct entities, with a key of the text, are moved to be joined with their surrogates, and the
texts once to be joined with theirs; an entity or a text that is very common is one row of the smaller side, and the other side of the join may be split.

All patterns repeat groups a bounded number of times, so a text of any length and form needs a bounded stack.

Odd rows: null texts stay null; rows without doc_id are treated like others; equal texts have equal results; all other columns stay as they are,
whatever their names, but that a report's two columns take the place of columns of the same names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Titles before a name and their gender; given names and surnames by script.
MALE, FEMALE = ("Mr", "Herr", "Señor", "Monsieur", "Don"), ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mademoiselle", "Doña")
NAMES = {
    ("m", "latin"): "James John Robert Michael David Thomas Daniel Paul Mark Peter Simon Henry Oscar Felix Hugo Leon Martin Victor Adrian Julian".split(),
    ("f", "latin"): "Mary Anna Laura Emma Julia Sarah Alice Clara Helen Nora Rosa Lucy Eva Ida Martha Sofia Elena Marie Olivia Irene".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Николай Сергей Михаил Андрей Павел Олег Виктор".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Вера Софья Юлия".split(),
    ("m", "greek"): "Γιώργος Νίκος Κώστας Δημήτρης Πέτρος Ανδρέας Μιχάλης Χρήστος".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Δέσποινα Ειρήνη Χριστίνα".split(),
}
#: Patterns by kind, the first that fits a found string names its kind.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,126}\.[A-Za-z]{2,63}",
    "secret": r"(?i:pass(?:word|wd)?|pwd|token|secret|api[_-]?key|access[_-]?key)\s*[=:]\s*(?:\"[^\"\s]{6,}\"|'[^'\s]{6,}'|[^\s\"',;]{6,})",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}\b|\bsk-[A-Za-z0-9]{20,}\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)",
    "name": r"\b(?:" + "|".join([*MALE, *FEMALE, "Dr", "Prof"]) + r")\b\.? \p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)?",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: So many attempts keep an entity's form; longer bodies don't keep it.
ROUNDS, LONGEST = 24, 256


def kind_of(entity: Column) -> Column:
    return reduce(lambda c, k: c.when(F.regexp_like(entity, F.lit(f"^(?:{KINDS[k]})$")), k), list(KINDS)[1:], F.when(F.regexp_like(entity, F.lit(f"^(?:{KINDS['email']})$")), "email")).otherwise("other")


#: Classes of characters, each replaced within itself.
ALPHABETS = (
    ("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"[\x{df}-\x{f6}\x{f8}-\x{ff}]", "àáâãäåçèéêëìíîïñòóôõöùúûüý"), (r"[\x{c0}-\x{d6}\x{d8}-\x{de}]", "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"),
    (r"[\x{430}-\x{44f}]", "абвгдежзийклмнопрстуфхцчшщыэюя"), (r"[\x{410}-\x{42f}]", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ"),
    (r"[\x{3ac}-\x{3ce}]", "αβγδεζηθικλμνξοπρστυφχψω"), (r"[\x{386}-\x{3ab}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"\p{N}", "0123456789"), (r"\p{Lu}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"\p{L}", "abcdefghijklmnopqrstuvwxyz"),
)


def _luhn(digits: Column) -> Column:
    """The sum of a number's digits, every second from the right but one doubled, modulo 10; 0 if its check digit is right."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    values = F.transform(each, lambda c, i: c.cast("int") * (i % 2 + 1))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10


def _number(i: Column | int, stream: str = "stream") -> Column:
    """Keyed number i, below 65,536: four hexadecimal digits of the stream each."""
    return F.conv(F.substring(F.col(stream), (F.lit(i) if isinstance(i, int) else i) * 4 + F.lit(1), F.lit(4)), 16, 10).cast("int")


def with_surrogates(rows: DataFrame, key: str) -> DataFrame:
    """rows(kind, entity, attempt, ...) with a column surrogate. An entity is a head that stays, a body each of whose letters and digits is
    replaced within its class, and a tail that stays."""
    kind, entity = F.col("kind"), F.col("entity")
    names = rows.columns
    rows = rows.withColumn("seed", F.sha2(F.concat_ws("\n", F.lit(key), kind, F.col("attempt").cast("string"), entity), 256))
    rows = rows.withColumn("stream", F.array_join(F.transform(F.sequence(F.lit(0), (F.least(F.length(entity), F.lit(2 * LONGEST)) / 16).cast("int") + 1), lambda i: F.sha2(F.concat_ws(":", "seed", i.cast("string")), 256)), ""))
    heads = {"secret": r"^[^=:]*[=:]\s*[\"']?", "key": r"^(?:AKIA|ASIA|gh[pousr]_|sk-)", "phone": r"^\+\d{1,3}(?=[^\d])", "card": r"^\d", "iban": r"^..", "name": r"^\p{L}+\.? (?:\S+ (?=\S))?"}
    head = reduce(lambda c, k: c.when(kind == k, F.regexp_extract(entity, heads[k], 0)), heads, F.when(kind == "email", "")).otherwise("")
    tail = F.when(kind == "email", F.regexp_extract(entity, r"\.[^.]*$", 0)).otherwise("")
    rows = rows.withColumn("head", head).withColumn("tail", tail)
    rows = rows.withColumn("body", F.substring(entity, F.length("head") + 1, F.length(entity) - F.length("head") - F.length("tail")))
    rows = rows.withColumn("end", F.regexp_extract("body", "[\"']$", 0)).withColumn("long", F.length("body") > LONGEST).withColumn("body", F.substring("body", 1, LONGEST))
    alphabet = lambda c: reduce(lambda w, x: w.when(F.regexp_like(c, F.lit(x[0])), x[1]), ALPHABETS, F.when((kind == "secret") & F.col("hexadecimal") & F.regexp_like(c, F.lit("[0-9a-f]")), "0123456789abcdef")).otherwise(c)
    rows = rows.withColumn("hexadecimal", F.regexp_like("body", F.lit("^[0-9a-f]+[\"']?$")))
    chars = F.transform(F.filter(F.split("body", ""), lambda c: c != ""), lambda c: alphabet(c))
    rows = rows.withColumn("free", (F.col("attempt") >= ROUNDS) | F.col("long") | ~F.exists(chars, lambda a: F.length(a) > 1))
    rows = rows.withColumn("made", F.array_join(F.transform(chars, lambda a, i: F.substring(a, _number(i) % F.length(a) + F.lit(1), F.lit(1))), ""))
    # a number's check digit is right if it was right
    plain = F.regexp_replace(F.concat("head", F.substring(F.col("made"), F.lit(1), F.length("made") - 1), F.lit("0")), "[^0-9]", "")
    card = F.when(_luhn(F.regexp_replace(entity, "[^0-9]", "")) == 0, F.concat("head", F.substring(F.col("made"), F.lit(1), F.length("made") - 1), ((10 - _luhn(plain)) % 10).cast("string"))).otherwise(F.concat("head", "made"))
    octets = F.concat_ws(".", _number(0) % 223 + 1, _number(1) % 256, _number(2) % 256, _number(3) % 256)
    title = F.regexp_extract("head", r"^\p{L}+", 0)
    gender = F.when(title.isin(*FEMALE), "f").when(title.isin(*MALE), "m").otherwise(F.when(_number(0) % 2 == 0, "f").otherwise("m"))
    script = F.when(F.regexp_like(entity, F.lit(r"[\x{400}-\x{4ff}]")), "cyrillic").when(F.regexp_like(entity, F.lit(r"[\x{370}-\x{3ff}]")), "greek").otherwise("latin")
    given = F.element_at(F.create_map(*[x for (g, s), ns in NAMES.items() for x in (F.lit(g + s), F.array(*map(F.lit, ns)))]), F.concat(gender, script))
    rows = rows.withColumn("given", F.when((kind == "name") & F.regexp_like("head", F.lit(r" \S")), given))
    name = F.when(F.col("given").isNotNull(), F.concat(F.regexp_extract("head", r"^\p{L}+\.? ", 0), F.element_at("given", _number(1) % F.size("given") + 1), F.lit(" "), "made")).otherwise(F.concat("head", "made"))
    # a body out of the entity's form
    keyed = F.sha2(F.concat_ws(":", "seed", F.lit("free")), 256)
    letters, digits = F.substring(F.translate(keyed, "0123456789", "qrstuvwxyz"), 1, 20), F.substring(F.translate(keyed, "abcdef", "012345"), 1, 24)
    groups = lambda text, n, by: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(text, i * 4 + F.lit(1), F.lit(4))), by)
    free = (
        F.when(kind == "secret", F.concat("head", letters, F.col("end")))
        .when(kind == "email", F.concat(letters, F.regexp_extract("made", "@.*$", 0), "tail"))
        .when(kind == "name", F.concat(F.when(F.col("given").isNotNull(), F.concat(F.regexp_extract("head", r"^\p{L}+\.? ", 0), F.element_at("given", _number(1) % F.size("given") + 1), F.lit(" "))).otherwise(F.col("head")), F.initcap(letters)))
        .when(kind == "phone", F.concat(F.when(F.col("head") == "", "+1").otherwise(F.col("head")), F.lit(" "), groups(digits, 5, " ")))
        .when(kind == "ip", F.concat(F.lit("fd00:"), groups(keyed, 7, ":")))
        .otherwise(F.concat("head", "made", "tail", digits))
    )
    return rows.select(*names, F.when(F.col("free"), free).when(kind == "ip", octets).when(kind == "card", card).when(kind == "name", name).otherwise(F.concat("head", "made", "tail")).alias("surrogate"))


def table(entities: DataFrame, key: str) -> DataFrame:
    """entities(kind, entity), distinct -> (kind, entity, surrogate): all surrogates differ from one another and from all entities."""
    rows = cut(with_surrogates(entities.withColumn("attempt", F.lit(0)), key))
    while True:
        # of equal surrogates one stays, that of the smallest entity that has made most attempts
        first = rows.groupBy("surrogate").agg(F.min(F.struct((-F.col("attempt")).alias("a"), "kind", "entity")).alias("first"), F.count("*").alias("c")).where("c > 1").select("surrogate", "first")
        real = rows.select(F.col("entity").alias("surrogate")).distinct().withColumn("real", F.lit(True))
        met = rows.join(first, "surrogate", "left").join(real, "surrogate", "left")
        again = F.coalesce(F.col("real"), F.lit(False)) | (F.col("first").isNotNull() & ((F.col("first.kind") != F.col("kind")) | (F.col("first.entity") != F.col("entity"))))
        marked = cut(met.select("kind", "entity", "attempt", "surrogate", F.coalesce(again, F.lit(False)).alias("again")))
        rows = marked
        if marked.where("again").isEmpty():
            return rows.select("kind", "entity", "surrogate")
        anew = with_surrogates(marked.where("again").select("kind", "entity", (F.col("attempt") + 1).alias("attempt")), key)
        rows = cut(marked.where("not again").select("kind", "entity", "attempt", "surrogate").unionByName(anew))


def replace_entities(docs: DataFrame, key: str, report: bool = True) -> DataFrame:
    """docs with surrogates in text; with a report also n_entities (replaced in the text) and kinds (theirs, in order). The key is the secret that
    makes surrogates what they are: the same key gives the same ones, and without it they can't be traced back by trying."""
    found = F.regexp_extract_all(F.col("text"), F.lit(PATTERN), F.lit(0))
    hashed = F.struct(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"), F.length("text").alias("n"))
    # what hints at an entity at all; most texts need no search
    hint = F.regexp_like("text", F.lit(r"[@+(]|AKIA|ASIA|gh[pousr]_|sk-|[0-9][^\p{L}]{0,3}[0-9]|[=:]|\b(?:" + "|".join([*MALE, *FEMALE, "Dr", "Prof"]) + r")\b"))
    entities = docs.where(hint).select(hashed.alias("text_key"), F.explode(F.array_distinct(found)).alias("entity")).distinct().withColumn("kind", kind_of(F.col("entity")))
    plan = cut(entities.where((F.col("kind") != "card") | (_luhn(F.regexp_replace("entity", "[^0-9]", "")) == 0)))
    fakes = table(plan.select("kind", "entity").distinct(), key)
    maps = cut(plan.join(fakes, ["kind", "entity"]).groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("entity", F.struct("surrogate", "kind")))).alias("fakes")))
    names = [c for c in docs.columns if not (report and c in ("n_entities", "kinds"))]
    some = F.coalesce(hint & F.regexp_like("text", F.lit(PATTERN)), F.lit(False))
    none = (F.lit(0).alias("n_entities"), F.array().cast("array<string>").alias("kinds")) if report else ()
    clear = docs.where(~some).select(*names, *none)
    # the rows as one column, so that no name of theirs can clash
    near = docs.where(some).select(F.struct(*names).alias("row"), hashed.alias("key")).join(maps, F.col("key") == F.col("text_key"), "left")
    text = F.col("row")["text"]
    pieces = F.arrays_zip(F.split(text, PATTERN, -1).alias("p"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("f"))
    # each piece, the entity behind it, and what takes its place (null for none)
    near = near.select("row", F.transform(pieces, lambda x: F.struct(x["p"].alias("p"), x["f"].alias("f"), F.element_at("fakes", x["f"]).alias("new"))).alias("parts"))
    rebuilt = F.array_join(F.transform("parts", lambda x: F.concat(F.coalesce(x["p"], F.lit("")), F.coalesce(x["new"]["surrogate"], x["f"], F.lit("")))), "")
    kinds = F.transform(F.filter("parts", lambda x: x["new"].isNotNull()), lambda x: x["new"]["kind"])
    columns = [rebuilt.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in names]
    return clear.unionByName(near.select(*columns, *((F.size(kinds).alias("n_entities"), kinds.alias("kinds")) if report else ())))
