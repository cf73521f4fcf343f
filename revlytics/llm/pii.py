"""Personal data replaced by surrogates, in DataFrame functions only.

1. One pattern finds e-mail addresses (in any script), IP addresses of both lengths, phone, card, identity and bank account numbers, and names
   after a title (in capitals too, with initials, known second names and particles), in whole texts. It runs once over a text; the text's pieces (gaps and finds in turn) are kept.
2. Each distinct entity (in a normal form, so that spellings of one entity stay one) gets a surrogate
   from SHA-256 of a secret key, its kind and itself: digits for digits, letters of the same case and
   script for letters, country and network prefixes kept, check digits valid where they were. Given and family names are
   entities of their own, so that Mrs. Schmidt keeps the name of Mrs. Anna Schmidt. A given name under a title without gender (Dr.)
   takes the gender that the corpus has for it, where there is one only; its surrogate is of that gender and of the name's script.
3. Surrogates are checked for collisions, with one another and with real entities; those that lose
   are drawn again, from some draw on longer by a letter or digit a draw (addresses: in a wider network, then in the format with 128 bits), so
   that no space is used up.
4. Occurrences take their entity's surrogate in their own format (separators, brackets, case). Untitled occurrences of a full or
   family name that the same text has under a title are replaced too.

Null texts stay null with counts 0; empty texts stay; repeated rows give equal rows; all columns are kept with their
values; a count whose name (n_email, ...) docs has already is called n_email_. The key comes from the caller.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlytics.llm.common import at, carried, free_name, restored, scratch_dir, stage, table

# Titles by gender, and first names by gender and script.
TITLES = {
    "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|госпожа|г-жа|κυρία",
    "m": "Mr|Herr|Monsieur|Señor|Sr|господин|г-н|κύριος",
    "u": "Mx|Dr|Prof",
}
FIRST_NAMES = {
    "Lf": "Anna Clara Emma Julia Laura Lena Maria Marta Nora Paula Sara Sofia",
    "Lm": "Adam Bruno David Emil Felix Hugo Jonas Karl Lukas Martin Oscar Victor",
    "Lu": "Alex Andrea Charlie Dominique Jules Kim Luca Robin Sacha Sasha Toni Val",
    "Cf": "Анна Вера Дарья Елена Ирина Мария Нина Ольга",
    "Cm": "Антон Борис Виктор Игорь Иван Лев Олег Павел",
    "Cu": "Валя Женя Саша Шура",
    "Gf": "Άννα Ελένη Ειρήνη Μαρία Σοφία",
    "Gm": "Γιώργος Νίκος Πέτρος Σπύρος",
    "Gu": "Αλέξης Άρης",
}
SYLLABLES = {"L": "ba da fe ga ho ka le ma ni or pe ra si ta vo zu", "C": "ба да фе га хо ка ле ма ни ор пе ра си та во зу", "G": "βα δα φε γα χο κα λε μα νι ορ πε ρα σι τα βο ζυ"}
#: What stands before a family name and belongs to it.
PARTICLES = "de|da|do|dos|das|di|del|della|du|la|le|van|von|vom|der|den|ten|ter|zu|zur|af|bin|ibn|el|al|y"
_TITLE = "(?i:" + "|".join(TITLES.values()) + ")"
_WORD, _INITIAL = r"\p{Lu}[\p{L}'’-]+", r"\p{Lu}\."
_GIVEN = "(?:" + "|".join(" ".join(FIRST_NAMES.values()).split()) + r")(?![\p{L}'’-])"
#: One given name and perhaps more that are known ones or initials, particles, a family name; or a family name alone.
_NAME = rf"(?:(?:{_WORD}|{_INITIAL})(?: (?:{_GIVEN}|{_INITIAL}))*(?: (?:{PARTICLES}))* {_WORD}|(?:(?:{PARTICLES}) )*{_WORD})"
_HEX = "[0-9A-Fa-f]{1,4}"
# The kinds' patterns, in the order in which they are tried.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "phone": r"(?<![\w+])(?:\+1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![\w+.-])(?:\+1[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-])|(?<![\w+])\+1 [0-9]{3} [0-9]{3} [0-9]{4}(?![0-9])|(?<![\w+.-])(?<![0-9] )[0-9]{3} [0-9]{3} [0-9]{4}(?![\w-]| [0-9])|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?\(0\))?[ .-]?[0-9](?:[ .-][0-9]{2,4}){3,4}(?![0-9])|(?<![\w+])\+[0-9]{1,3}[ .-]?\(0\)[ .-]?[0-9]{1,5}(?:[ .-]?[0-9]{2,8}){1,4}(?![0-9])|(?<![\w+])\+(?!1[ (])[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}(?![0-9])",
    # The second form: eight groups, or fewer around a double colon with three colons in all.
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])|(?<![\w:.])(?=(?:[0-9A-Fa-f]*:){{3}})(?:(?:{_HEX}:){{7}}{_HEX}|{_HEX}(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\w:])",
    "card": r"(?<!\w)(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{4})(?!\w)",
    "identity": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])|(?<![\w-])(?<![0-9] )[0-9]{3} [0-9]{2} [0-9]{4}(?![\w-]| [0-9])",
    "account": r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_TITLE}\.? {_NAME}",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(PATTERNS.values())
#: A text without one of these holds no entity; cheaper to look for.
HINT = r"@|[0-9]{3}|[0-9]\.[0-9]|\+[0-9]|[A-Z]{2}[0-9]{2}|:[0-9A-Fa-f]{0,4}:|" + _TITLE + r"\.? \p{L}"
MOST_DRAWS = 64
#: Draws from which surrogates grow.
GROW = 8
#: Endings of drawn given names by gender and script.
ENDINGS = {"Lf": "a", "Lm": "o", "Lu": "e", "Cf": "а", "Cm": "ий", "Cu": "и", "Gf": "α", "Gm": "ος", "Gu": "ι"}
#: Stands between the pieces of a text while it is taken apart; texts that hold it are taken apart in two passes.
_BORDER = "\ue0f1\ue0f2\ue0f3"


def kind_of(found: Column) -> Column:
    out = None
    for k, p in PATTERNS.items():
        test = found.rlike("^(?:" + p + ")$")
        out = F.when(test, k) if out is None else out.when(test, k)
    return out.otherwise(KINDS[-1])


def normal(kind: Column, found: Column) -> Column:
    """What spellings of one entity share; of a name the family name with its script."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    return (
        F.when(kind.isin("email", "ip"), F.lower(found)).when(kind == "account", F.regexp_replace(found, " ", ""))
        .when(kind == "name", F.concat(_script(found), F.lit("-:"), F.element_at(F.split(found, " "), -1)))
        .when((kind == "phone") & ~found.startswith("+"), F.concat(F.lit("1"), digits))
        .otherwise(digits)
    )


def _script(name: Column) -> Column:
    last = F.element_at(F.split(name, " "), -1)
    return F.when(last.rlike(r"^\p{IsCyrillic}"), "C").when(last.rlike(r"^\p{IsGreek}"), "G").otherwise("L")


def _gender(found: Column) -> Column:
    return F.when(found.rlike(f"^(?i:{TITLES['f']})\\.? "), "f").when(found.rlike(f"^(?i:{TITLES['m']})\\.? "), "m").otherwise("u")


def _stream(key: str) -> str:
    """64 pairs of hex digits from the key, the entity and the draw."""
    return f"concat(sha2(concat_ws('|', '{key}', kind, entity, draw, 'a'), 256), sha2(concat_ws('|', '{key}', kind, entity, draw, 'b'), 256))"


def _byte(i: str) -> str:
    return f"cast(conv(substr(h, 2 * (({i}) % 64) + 1, 2), 16, 10) as int)"


def _more() -> str:
    """Letters or digits by which a surrogate is longer."""
    return f"greatest(0, draw - {GROW - 1})"


def _digits(first: int, length: str) -> str:
    """The entity's first digits, then drawn ones."""
    return f"concat(left(entity, {first}), array_join(transform(sequence(1, {length} - {first}), i -> cast({_byte('i')} % 10 as string)), ''))"


def _luhn(s: str) -> str:
    """Sum of Luhn's check over a string of digits."""
    return (
        f"aggregate(sequence(1, length({s})), 0L, (a, i) -> a + (case when (length({s}) - i) % 2 = 0 then cast(substr({s}, i, 1) as int) "
        f"else (2 * cast(substr({s}, i, 1) as int)) div 10 + (2 * cast(substr({s}, i, 1) as int)) % 10 end))"
    )


def _mod97(s: str) -> str:
    """Remainder by 97 of letters and digits, letters as 10 to 35."""
    value = f"(case when substr({s}, i, 1) between '0' and '9' then cast(substr({s}, i, 1) as int) else ascii(substr({s}, i, 1)) - 55 end)"
    return f"aggregate(sequence(1, length({s})), 0L, (a, i) -> (a * (case when {value} > 9 then 100 else 10 end) + {value}) % 97)"


def _like(s: str, offset: int) -> str:
    """Each letter or digit replaced by one of its class."""
    c = f"substr({s}, i, 1)"
    b = _byte(f"i + {offset}")
    return (
        f"array_join(transform(sequence(1, length({s})), i -> case when {c} between '0' and '9' then cast({b} % 10 as string) "
        f"when {c} between 'a' and 'z' then char(97 + {b} % 26) when {c} between 'A' and 'Z' then char(65 + {b} % 26) when {c} rlike '[^\\\\x00-\\\\x7F]' then char(97 + {b} % 26) else {c} end), '')"
    )


def _pick(words: str, i: str) -> str:
    found = words.split()
    return f"element_at(array({', '.join(repr(w) for w in found)}), 1 + {_byte(i)} % {len(found)})"


def _syllables(number: str) -> str:
    parts = []
    for script, words in SYLLABLES.items():
        found = words.split()
        listed = f"array({', '.join(repr(w) for w in found)})"
        parts.append(f"when '{script}' then array_join(transform(sequence(1, {number}), i -> element_at({listed}, 1 + {_byte('i')} % {len(found)})), '')")
    return "case left(entity, 1) " + " ".join(parts) + " end"


def _given() -> str:
    """A listed name at the first draws, then syllables with the gender's ending."""
    listed = "case left(entity, 2) " + " ".join(f"when '{k}' then {_pick(v, '40')}" for k, v in FIRST_NAMES.items()) + " end"
    ending = "case left(entity, 2) " + " ".join(f"when '{k}' then '{v}'" for k, v in ENDINGS.items()) + " end"
    return f"case when draw < 3 then {listed} else concat(initcap({_syllables('cast(3 + draw div 3 as int)')}), {ending}) end"


def _address() -> str:
    b = [f"cast({_byte(str(i))} as string)" for i in (10, 11)]
    last = f"cast(1 + {_byte('12')} % 254 as string)"
    public = f"(array(11, 23, 45, 64, 81, 99, 130, 151, 163, 178, 185, 193, 203, 212))[{_byte('9')} % 14]"
    wide = "concat('fd', substr(h, 1, 2), ':', substr(h, 3, 4), ':', substr(h, 7, 4), '::', substr(h, 11, 4), ':', substr(h, 15, 4))"
    private = f"entity like '10.%' or draw >= {GROW}"
    return (
        f"case when draw >= {2 * GROW} or entity like '%:%' then {wide} when {private} then concat_ws('.', '10', {b[0]}, {b[1]}, {last}) when entity like '192.168.%' then concat_ws('.', '192.168', {b[1]}, {last}) "
        f"when entity rlike '^172[.](1[6-9]|2[0-9]|3[01])[.]' then concat_ws('.', '172', cast(16 + {_byte('10')} % 16 as string), {b[1]}, {last}) "
        f"when entity like '169.254.%' then concat_ws('.', '169.254', {b[1]}, {last}) when entity like '127.%' then concat_ws('.', '127', {b[0]}, {b[1]}, {last}) "
        f"else concat_ws('.', cast({public} as string), {b[0]}, {b[1]}, {last}) end"
    )


def drawn(pending: DataFrame, key: str) -> DataFrame:
    """kind, entity, draw -> with surrogate, in normal form (of names without script and gender)."""
    key = hashlib.sha256(key.encode()).hexdigest()
    longer = f"case when draw >= 3 then cast({_byte('50')} * 256 + {_byte('51')} as string) else '' end"
    length = f"length(entity) + {_more()}"
    full = pending.withColumn("h", F.expr(_stream(key)))
    full = full.withColumn(
        "surrogate",
        F.when(F.col("kind") == "email", F.expr(f"concat({_like("split_part(entity, '@', 1)", 0)}, {longer}, '@', 'm', lower(left(sha2(concat('{key}', split_part(entity, '@', 2)), 256), 16)), '.example.', element_at(split(entity, '[.]'), -1))"))
        .when(F.col("kind").isin("phone", "card"), F.expr(_digits(1, length)))
        .when(F.col("kind") == "ip", F.expr(_address()))
        .when(F.col("kind") == "identity", F.expr(f"concat('9', array_join(transform(sequence(1, 8 + {_more()}), i -> cast({_byte('i')} % 10 as string)), ''))"))
        .when(F.col("kind") == "account", F.expr(f"concat(left(entity, 4), {_like('substr(entity, 5)', 0)}, left(upper(h), {_more()}))"))
        .when(F.col("kind") == "given", F.expr(_given()))
        .otherwise(F.expr(f"initcap({_syllables('cast(3 + draw div 3 as int)')})")),
    )
    body = "concat(left(surrogate, length(surrogate) - 1), '0')"
    checked = F.expr(f"concat(left(surrogate, length(surrogate) - 1), cast((10 - {_luhn(body)} % 10) % 10 as string))")
    full = full.withColumn("surrogate", F.when((F.col("kind") == "card") & (F.expr(_luhn("entity")) % 10 == 0), checked).otherwise(F.col("surrogate")))
    turned = "concat(substr(surrogate, 5), left(surrogate, 2), '00')"
    account = F.expr(f"concat(left(surrogate, 2), lpad(cast(98 - {_mod97(turned)} as string), 2, '0'), substr(surrogate, 5))")
    return full.withColumn("surrogate", F.when(F.col("kind") == "account", account).otherwise(F.col("surrogate"))).drop("h")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, entity -> surrogate: distinct for distinct entities of a kind, and never a real entity."""
    real = stage(entities.select("kind", "entity").distinct(), "entities")
    pending, done = real.withColumn("draw", F.lit(0)), None
    for _ in range(MOST_DRAWS):
        tried = drawn(pending, key)
        plain = F.when(F.col("kind").isin("given", "name"), F.substring("entity", 4, 999)).otherwise(F.col("entity"))
        taken = real.select("kind", plain.alias("surrogate"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "surrogate"))
        fresh = tried.join(taken, ["kind", "surrogate"], "left_anti")
        winners = fresh.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))  # pre-aggregated: no group is gathered
        won = stage(winners.select("kind", "entity", "surrogate"), "won")
        done = won if done is None else done.unionByName(won)
        pending = stage(tried.select("kind", "entity", (F.col("draw") + 1).alias("draw")).join(won, ["kind", "entity"], "left_anti"), "pending")
        if pending.isEmpty():
            return done
    raise ValueError(f"some surrogates still collide after {MOST_DRAWS} draws")


def shown(kind: Column, found: Column, surrogate: Column) -> Column:
    """The surrogate of anything but a name in the occurrence's own format; what it has more comes at the end."""
    digits = F.when((kind == "phone") & ~found.startswith("+"), F.substring(surrogate, 2, 99)).otherwise(surrogate)
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("o"))
    fill = lambda test: F.aggregate(
        F.split(found, ""), start,
        lambda a, c: F.when(c.rlike(test), F.struct((a["i"] + 1).alias("i"), F.concat(a["o"], F.substr(digits, a["i"] + 1, F.lit(1))).alias("o"))).otherwise(F.struct(a["i"].alias("i"), F.concat(a["o"], c).alias("o"))),
        lambda a: F.concat(a["o"], F.substr(digits, a["i"] + 1, F.lit(99))),
    )
    upper = F.when(found == F.upper(found), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind == "email", upper).when(kind == "ip", surrogate).when(kind == "account", fill("[A-Z0-9]")).otherwise(fill("[0-9]"))


def pieces(text: Column) -> Column:
    """Gaps and finds of a text in turn (gap, find, gap, ..., gap); one run of the pattern over texts that can hold an entity."""
    marked = F.split(F.regexp_replace(text, ANY, f"{_BORDER}$0{_BORDER}"), _BORDER, -1)
    gaps, found = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    twice = F.flatten(F.transform(gaps, lambda g, i: F.when(i < F.size(found), F.array(g, F.get(found, i))).otherwise(F.array(g))))
    return F.when(text.rlike(HINT), F.when(text.contains(_BORDER[0]), twice).otherwise(marked))


def _named(found: DataFrame) -> DataFrame:
    """finds with given: the entity of a name's given name (script, gender, name), else null. The gender is the title's, or the only one that the corpus has."""
    words, is_name = F.split("found", " "), F.col("kind") == "name"
    first = F.when(is_name & (F.size(words) > 2) & ~F.get(words, 1).rlike(f"^(?:{PARTICLES})$"), F.get(words, 1))
    found = found.withColumns({"first": first, "gender": F.when(is_name, _gender(F.col("found"))), "script": F.when(is_name, _script(F.col("found")))})
    sexes = found.where("first is not null").groupBy("script", "first").agg(F.bool_or(F.col("gender") == "f").alias("f"), F.bool_or(F.col("gender") == "m").alias("m"))
    one = F.when(F.col("f") & ~F.col("m"), "f").when(F.col("m") & ~F.col("f"), "m").otherwise("u")
    found = found.join(sexes, ["script", "first"], "left")
    gender = F.when(F.col("gender") != "u", F.col("gender")).otherwise(one)
    return found.withColumn("given", F.when(F.col("first").isNotNull(), F.concat("script", gender, F.lit(":"), "first"))).drop("script", "first", "gender", "f", "m")


def _with_names(gap: Column) -> Column:
    """A gap with untitled full and family names of the text replaced, longer ones first."""

    def one(text: Column, x: Column) -> Column:
        # A name is letters, apostrophes and hyphens only, so it is its own pattern.
        return F.when(F.contains(text, x["real"]), F.regexp_replace(text, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), x["real"], F.lit(r"(?![\p{L}\p{N}])")), x["new"])).otherwise(text)

    return F.aggregate("names", gap, one)


def replace_pii(docs: DataFrame, key: str, text_col: str = "text", counts: bool = True) -> DataFrame:
    """All rows and columns of docs with surrogates in the text, and n_<kind> counts of the entities replaced."""
    source = docs.select(carried(docs, text_col).alias("row"), at(text_col).alias("text")).withColumn("pieces", pieces(F.col("text")))
    holds = F.coalesce(F.size("pieces") > 1, F.lit(False))
    source = source.select("row", F.when(~holds, F.col("text")).alias("text"), F.when(holds, F.col("pieces")).alias("pieces"), F.monotonically_increasing_id().alias("uid"))
    source = stage(source, "pieces")  # the row numbers are fixed by being written
    held = source.where("pieces is not null")
    found = held.select("uid", F.posexplode("pieces").alias("at", "found")).where("at % 2 = 1")
    found = found.withColumn("kind", kind_of(F.col("found")))
    found = stage(_named(found.withColumn("entity", normal(F.col("kind"), F.col("found")))), "found")
    entities = found.select("kind", "entity").unionByName(found.where("given is not null").select(F.lit("given").alias("kind"), F.col("given").alias("entity")))
    given = surrogates(entities, key)
    first = given.where("kind = 'given'").select(F.col("entity").alias("given"), F.col("surrogate").alias("first"))
    new = found.join(given, ["kind", "entity"]).join(first, "given", "left")
    is_name, name = F.col("kind") == "name", F.concat_ws(" ", "first", "surrogate")
    title, real = F.regexp_extract("found", r"^\S+ ", 0), F.regexp_replace("found", r"^\S+ ", "")
    new = new.select(
        "uid", "at", "kind", F.when(is_name, F.concat(title, name)).otherwise(shown(F.col("kind"), F.col("found"), F.col("surrogate"))).alias("new"),
        F.when(is_name, F.array(F.struct(real.alias("real"), name.alias("new")), F.struct(F.substring("entity", 4, 999).alias("real"), F.col("surrogate").alias("new")))).alias("names"),
    )
    count = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS]
    listed = F.array_distinct(F.flatten(F.collect_list("names")))
    by_text = new.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("new"), listed.alias("names"), *count)  # one text's entities
    by_text = by_text.withColumn("names", F.array_sort("names", lambda x, y: F.length(y["real"]) - F.length(x["real"])))
    text = F.array_join(F.transform("pieces", lambda p, i: F.when(i % 2 == 1, F.get("new", (i / 2).cast("int"))["new"]).otherwise(_with_names(p))), "")
    done = held.join(by_text, "uid").select("row", text.alias("text"), *(f"n_{k}" for k in KINDS))
    clean = source.where("pieces is null").select("row", "text", *(F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS))
    shown_counts = [F.col(f"n_{k}").alias(free_name(docs, f"n_{k}")) for k in KINDS] if counts else []
    return clean.unionByName(done).select(*restored(docs, text_col, F.col("text")), *shown_counts)


def own_key(spark: SparkSession) -> str:
    """The session's revlytics.pii.key; where it is unset, a random key that is drawn once and kept in the shared folder."""
    given = spark.conf.get("revlytics.pii.key", None)
    if given:
        return given
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(f"{scratch_dir(spark)}/pii-key")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        out = store.create(path, False)  # fails if another has drawn one meanwhile
        out.writeUTF(secrets.token_hex(32))
        out.close()
    held = store.open(path)
    try:
        return held.readUTF()
    finally:
        held.close()


def op8_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    out = replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), own_key(spark))
    return out.withColumn("n_entities", sum((F.col(f"n_{k}") for k in KINDS), F.lit(0).cast("long")))
