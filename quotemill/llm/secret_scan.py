"""Secret scanning: candidates by pattern, false positives removed by a random forest; DataFrame operations only.

Candidates are, from left to right and without overlap: values of ``ASSIGNED_LENGTH`` characters or more, of any kind but white space and
quotes, that are assigned to a name with a secret's word in it; passwords in URLs; and runs that stand alone and hold a digit, either of ``MIN_LENGTH`` letters, digits and
``+ / _ -`` (with padding), or of three parts with dots between; private keys in armour, whole; runs that begin like those of well-known issuers need no digit.  A name before ``=`` is no part of its value.  Length is not capped anywhere.

Features are a candidate's length, its distinct characters and character transitions, how much of it known words cover, what
the words before and after it say, and what the row's path says.  The forest (the JVM implementation of Spark's ML library)
is trained from labelled findings: a table of (doc_id, secret, label) if there is one, or else :func:`planted_findings`, generated secrets and
decoys of known kind that are put into surroundings of the corpus; their labels come from how they were made, not from the features, and
kinds overlap: real formats stand without a name, decoys stand behind secrets' words, and credentials of test folders are no secrets.

At most ``TRAINING_ROWS`` labelled findings, by hash, train the forest; every candidate of every text is scored.

Defined results: null and empty texts hold no candidate; a candidate that repeats is one finding each time, numbered
from 1 in its text; repeated rows repeat their findings, and rows with one doc_id and different texts are decided apart; where only one label is
known, all candidates get it, and without any label the probability is 0.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotemill.llm.common import bounded_sample, stored

MIN_LENGTH, ASSIGNED_LENGTH = 12, 6
TRAINING_ROWS = 8_000
#: Texts of the corpus whose pieces surround planted findings.
CONTEXTS = 500
REDACTED = "<SECRET>"
#: Words around secrets, words of examples, formats of well-known issuers, and common parts of plain tokens.
SECRET_WORDS = "token|secret|passw|passwd|passphrase|pass(?![a-z])|pwd|api[ _-]?key|apikey|access[ _-]?key|private[ _-]?key|credential|bearer|authorization|auth[_-]?key|client[_-]?id|signature"
EXAMPLE_WORDS = "example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test|fake|redacted|localhost"
PLAIN_WORDS = "sha256|sha1|md5|checksum|digest|commit|revision|uuid|guid|isbn|phone|tel|fax|order|invoice|version|build|serial|page|card|account|iban"
ISSUER = "^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^sk_(live|test)_[A-Za-z0-9]{16,}$|^AIza[A-Za-z0-9_-]{35}$|^eyJ[A-Za-z0-9_-]{10,}|^-----BEGIN "
DICTIONARY = (
    "admin and api app auth back base begin build card client code commit config content copy create data date default delete demo dev digest domain email end error example "
    "false file final first for form from func get group hash head host html http https id image index info init input item key lang last level line link list local lock log "
    "login main map max message min mode module month name new next node none null number object off old open order out page param part pass password path phone port post "
    "prev print private prod project public query read release report request result return role root row sample save script secret select serial server session set sha size "
    "source start state status string style sub system table tag target temp test text the this time title token total true type unit update url use user uuid value var "
    "version view web with word work write year zone"
).split()
FEATURES = ["length", "distinct_share", "digit_share", "upper_share", "lower_share", "to_digit", "to_alpha", "case_moves", "symbols", "coverage", "hex_like", "digits_only", "issuer", "dotted", "secret_before", "assigned", "quoted", "in_url", "plain_before", "example_near", "secret_after", "host_after", "test_path"]

#: The secret's words that can begin a name, by first letter: most places of a text are passed after six comparisons.
_WORDS = r"(?:[tT](?i:oken)|[sS](?i:ecret|ignature)|[pP](?i:assw|assphrase|(?<![A-Za-z][pP])ass(?![a-z])|wd|rivate[ _-]?key)|[aA](?i:pi[ _-]?key|ccess[ _-]?key|uthorization|uth[_-]?key|uth[_-]?token)|[cC](?i:redential|lient[_-]?id)|[bB](?i:earer))"
_NAME = rf"{_WORDS}[A-Za-z0-9_-]*+[\"'`]?\s{{0,4}}(?:=>|:=|[:=])\s{{0,4}}[\"'`]?"
_VALUE = rf"[^\s\"'`,;<>(){{}}\[\]]{{{ASSIGNED_LENGTH},}}+"
_LOGIN, _PASSWORD = r"://[^\s:/@\"'<>]*+:", r"[^\s/@\"'<>]{3,}+(?=@)"
_PLAIN = rf"(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}+={{0,2}}+(?![A-Za-z0-9+/_=-])"
_DOTTED = r"(?=[A-Za-z._-]*+[0-9])[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?![A-Za-z0-9_-])"
_ISSUED = r"(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_(?:live|test)_|AIza|eyJ)[A-Za-z0-9_-]{12,}+(?![A-Za-z0-9+/_=.-]*+[+/=])"
_ARMOUR = r"-----BEGIN (?:[A-Z]++ ){0,3}PRIVATE KEY(?: BLOCK)?-----[A-Za-z0-9+/=\\\s]{16,}+-----END [A-Z ]{0,30}-----"
#: What is matched; in the first two forms a name or login comes before the candidate itself.
_ANNOUNCED = rf"{_NAME}{_VALUE}|{_LOGIN}{_PASSWORD}"
_ALONE = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_.-]{{{MIN_LENGTH}}})(?:{_DOTTED}|{_PLAIN}|{_ISSUED})"
CANDIDATE = f"{_ANNOUNCED}|{_ARMOUR}|{_ALONE}"
_LEAD = rf"^(?:{_NAME}(?={_VALUE}$)|{_LOGIN}(?=[^\s/@\"'<>]{{3,}}$))"


def _suspect(text: Column) -> Column:
    """Whether a text holds a candidate; names and logins, which cost most to look for, only where there is a ``:`` or ``=``."""
    text = F.coalesce(text, F.lit(""))
    return text.rlike(_ALONE) | (text.rlike("[:=]") & text.rlike(_ANNOUNCED)) | (F.contains(text, F.lit("PRIVATE KEY")) & text.rlike(_ARMOUR))


def _lead(match: Column) -> Column:
    """The name or login that a match begins with."""
    return F.regexp_extract(match, f"({_LEAD})", 1)


def _cut(text: Column) -> tuple[Column, Column]:
    """All matches, and what stands around them: one piece more."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), F.lit(1)), F.split(text, CANDIDATE, -1)


def findings(docs: DataFrame, path: str | None = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text_hash, nth, secret, before, after, path of every candidate, and the columns of ``keep``."""
    where = docs[path].cast("string") if path and path in docs.columns else F.lit(None).cast("string")
    found, around = _cut(docs["text"])
    cut = docs.where(_suspect(F.col("text"))).select("doc_id", F.xxhash64("text").alias("text_hash"), where.alias("path"), found.alias("found"), around.alias("around"), *keep)
    each = cut.select("doc_id", "text_hash", "path", F.posexplode("found").alias("at", "match"), "around", *keep).withColumn("lead", _lead(F.col("match")))
    return each.select(
        "doc_id", "text_hash", (F.col("at") + 1).alias("nth"), F.substring("match", F.length("lead") + 1, F.length("match")).alias("secret"),
        F.right(F.concat(F.get("around", F.col("at")), "lead"), F.lit(48)).alias("before"), F.left(F.get("around", F.col("at") + 1), F.lit(32)).alias("after"), "path", *keep,
    )


def with_features(found: DataFrame) -> DataFrame:
    s, size = F.col("secret"), F.length("secret").cast("double")
    share = lambda chars: F.length(F.regexp_replace(s, f"[^{chars}]", "")) / size
    known = F.length(F.regexp_replace(F.lower(s), "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w))), ""))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    last = F.regexp_extract("before", r"(\S+\s*[:=]?\s*[\"'`(<]?)$", 1)
    columns = {
        "length": size, "distinct_share": F.size(F.array_distinct(F.split(s, ""))) / size, "digit_share": share("0-9"), "upper_share": share("A-Z"), "lower_share": share("a-z"),
        "to_digit": F.regexp_count(s, F.lit("(?<=[A-Za-z])(?=[0-9])")) / size, "to_alpha": F.regexp_count(s, F.lit("(?<=[0-9])(?=[A-Za-z])")) / size,
        "case_moves": F.regexp_count(s, F.lit("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")) / size, "symbols": F.regexp_count(s, F.lit("[^A-Za-z0-9]")) / size,
        "coverage": 1 - known / size, "hex_like": flag(s.rlike("^([0-9a-f]+|[0-9A-F]+)$")), "digits_only": flag(s.rlike("^[0-9_/+=-]+$")), "issuer": flag(s.rlike(ISSUER)), "dotted": flag(F.contains(s, F.lit("."))),
        "secret_before": flag(F.col("before").rlike(rf"(?i)({SECRET_WORDS})[A-Za-z0-9_-]*\W{{0,12}}$")), "assigned": flag(F.col("before").rlike(r"[:=]\W{0,6}$")), "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "in_url": flag(F.col("before").rlike("://[^\\s:/@]*:$")), "plain_before": flag(F.col("before").rlike(rf"(?i)\b({PLAIN_WORDS})\W{{0,4}}$")), "example_near": flag(F.concat(last, s, F.left("after", F.lit(16))).rlike(f"(?i){EXAMPLE_WORDS}")),
        "secret_after": flag(F.col("after").rlike(rf"(?i)^\W{{0,3}}({SECRET_WORDS})")), "host_after": flag(F.col("after").rlike("^[@.][A-Za-z0-9]")), "test_path": flag(F.col("path").rlike("(?i)test|mock|fixture|example|sample|doc")),
    }
    return found.withColumns({k: v.cast("double") for k, v in columns.items()})


def planted_texts(docs: DataFrame, rows: int = TRAINING_ROWS, seed: str = "planted", path: str | None = "source") -> DataFrame:
    """doc_id (the number of the row), text, path, planted, label: a generated secret (label 1) or decoy (0) in surroundings cut from a text of
    ``docs``.  About three in eight are secrets; the kinds are the entries below, in turn."""
    spark = docs.sparkSession
    rnd = lambda salt: F.sha2(F.concat_ws(":", F.lit(seed), F.lit(salt), F.col("id").cast("string")), 256)
    one = lambda salt, *of: F.get(F.array(*map(F.lit, of)), F.pmod(F.conv(F.left(rnd(salt), F.lit(8)), 16, 10).cast("long"), F.lit(len(of))))
    both = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    cut = lambda c, n, at=1: F.substring(c, at, n)
    base = lambda salt: F.base64(F.unhex(rnd(salt)))
    made = spark.range(rows).select(
        "id", rnd("hex").alias("hex"), F.concat(F.lit("4"), F.translate(rnd("digits"), "abcdef", "135790")).alias("digits"),
        F.regexp_replace(F.concat(*(base(f"mixed{i}") for i in range(4))), "[^A-Za-z0-9]", "").alias("mixed"), *(one(x, *DICTIONARY).alias(x) for x in "abcd"), one("quote", '"', "'", "`", "").alias("quote"),
        one("name", "token", "secret", "password", "api_key", "client_secret", "access_token", "auth_token", "passwd", "private_key", "API_TOKEN", "secretKey", "db_password", "DB_PASS", "pass").alias("name"), one("sep", " = ", "=", ": ", ":", " := ", " => ").alias("sep"),
        one("of", "value", "name", "key", "ref", "id", "item", "file", "hash", "digest", "commit", "sha256:", "etag", "order", "uuid", "trace").alias("of"), one("bare", " ", " ", "\n", "(", " <", ", ").alias("bare"), one("mark", "!", "#", "$", "&", "%").alias("mark"),
        one("issuer", "AKIA", "ghp_", "sk_live_", "xoxb-", "AIza").alias("issuer"), one("usual", "src/app.py", "conf/prod.yml", "notes", "web", "wiki").alias("usual"), one("tests", "tests/fixtures/a.py", "docs/example.md", "mock/data.json", "samples/x").alias("tests"),
        one("bearer", "Authorization: Bearer ", "bearer ", " ").alias("bearer"), one("scheme", "postgres", "https", "mysql", "amqp").alias("scheme"), one("fill", "your_", "example-", "changeme", "xxxxxxxx", "sample_").alias("fill"), one("end", ".", " ").alias("end"),
    )
    made = stored(made, like="ingredients")
    hex_, digits, mixed, a, b, c, d, quote, bare, usual = (made[x] for x in ("hex", "digits", "mixed", "a", "b", "c", "d", "quote", "bare", "usual"))
    named, plain = both(made["name"], made["sep"], quote), both(made["of"], made["sep"], quote)
    uuid = F.regexp_replace(cut(hex_, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    issued = F.when(made["issuer"] == "AKIA", both("AKIA", F.upper(cut(mixed, 16)))).when(made["issuer"] == "AIza", both("AIza", cut(mixed, 35))).otherwise(both(made["issuer"], cut(mixed, 36)))
    # (label, before, planted, after, path)
    kinds = [
        (1, named, cut(hex_, 40), quote, usual), (1, named, cut(mixed, 32), quote, usual), (1, named, both(F.initcap(a), made["mark"], cut(digits, 4), cut(mixed, 4)), quote, usual), (1, named, issued, quote, usual), (1, bare, issued, " ", usual),
        (1, made["bearer"], both("eyJ", cut(mixed, 20), ".", cut(mixed, 40, 21), ".", cut(mixed, 30, 61)), " ", usual), (1, both(made["scheme"], "://", a, ":"), both(cut(mixed, 6), cut(digits, 3), cut(mixed, 5, 7)), both("@", b, ".internal/"), usual), (1, named, cut(hex_, 32), quote, usual),
        (1, both("AWS_SECRET_ACCESS_KEY", made["sep"]), both(cut(mixed, 20), "/", cut(mixed, 19, 21)), " ", usual),
        (1, bare, both("-----BEGIN RSA PRIVATE KEY-----\n", cut(mixed, 60), "\n", cut(mixed, 60, 61), "\n-----END RSA PRIVATE KEY-----"), "\n", usual),
        (0, bare, cut(digits, 16), " ", usual), (0, plain, cut(hex_, 64), quote, usual), (0, plain, cut(hex_, 40), quote, usual), (0, plain, uuid, quote, usual), (0, bare, uuid, " ", usual), (0, bare, both(a, "_", b, "_", c, "_", cut(digits, 2)), " ", usual),
        (0, named, both(a, "_", b, "_", c), quote, usual), (0, named, both(made["fill"], b, "_", c, cut(digits, 1)), quote, usual), (0, named, cut(hex_, 40), quote, made["tests"]), (0, bare, both(a, "/", b, "/", c, "_", cut(digits, 1), "/", d), made["end"], usual),
        (0, bare, both("20", cut(digits, 2), "-", cut(digits, 2, 3), "-", cut(digits, 2, 5), "T", cut(digits, 6, 7)), " ", usual), (0, bare, both(a, "-", b, "-", c, "-", cut(digits, 4)), both("@", d, ".com"), usual), (0, both(made["name"], ": "), both(a, b), made["end"], usual),
        (0, named, cut(digits, 9), quote, usual), (0, plain, cut(mixed, 22), quote, usual),
    ]
    k = F.pmod("id", F.lit(len(kinds)))
    pick = lambda i: F.get(F.array(*(both(x[i]) for x in kinds)), k)
    made = made.select("id", *(pick(i).alias(x) for i, x in ((1, "pre"), (2, "planted"), (3, "post"), (4, "path"))), k.isin(*(j for j, x in enumerate(kinds) if x[0])).cast("double").alias("label"))
    pieces = bounded_sample(docs.select("doc_id", "text"), ["doc_id"], CONTEXTS).where("text is not null")
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text"), F.lit(1))).cast("int")
    pieces = pieces.select(F.regexp_replace(F.substring(F.col("text"), start + 1, F.lit(70)), r"\S*$", "").alias("left"), F.regexp_replace(F.substring(F.col("text"), start + 71, F.lit(40)), r"^\S*", "").alias("right"))
    pieces = stored(pieces.withColumn("k", F.row_number().over(W.orderBy("left", "right")) - 1), like="pieces")  # at most 2 * CONTEXTS short rows
    made = made.join(pieces, F.pmod(F.xxhash64("id"), F.lit(max(1, pieces.count()))) == pieces["k"], "left")
    text = F.concat(F.coalesce("left", F.lit("")), "pre", "planted", "post", F.coalesce("right", F.lit("")))
    return stored(made.select(F.col("id").alias("doc_id"), text.alias("text"), "path", "planted", "label"), like="planted")


def planted_findings(docs: DataFrame, rows: int = TRAINING_ROWS, seed: str = "planted") -> DataFrame:
    """The findings of :func:`planted_texts` that are what was planted, with features and label."""
    return with_features(findings(planted_texts(docs, rows, seed), "path", ("planted", "label")).where("secret = planted"))


def fit(featured: DataFrame, docs: DataFrame, labelled: DataFrame | None = None, rows: int = TRAINING_ROWS, trees: int = 40, depth: int = 9, seed: int = 7):
    """A forest from labelled findings, or the only label's value where one alone is known (0.0 if none)."""
    if labelled is None:
        known = planted_findings(docs, rows).select(*FEATURES, "label", "doc_id", "nth", "secret")
    else:
        given = bounded_sample(labelled.where("label is not null").select("doc_id", "secret", F.col("label").cast("double").alias("label")).distinct(), ["doc_id", "secret"], rows)
        known = featured.join(given, ["doc_id", "secret"]).select(*FEATURES, "label", "doc_id", "nth", "secret")
        known = bounded_sample(known, ["doc_id", "secret", "nth"], rows // 2)
    sample = stored(known.select(*FEATURES, "label").repartition(1).sortWithinPartitions(*FEATURES, "label"), like="sample")  # at most ``rows`` rows
    labels = sorted(r[0] for r in sample.select("label").distinct().collect())
    if len(labels) < 2:
        return labels[0] if labels else 0.0
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(data)


def with_probability(featured: DataFrame, forest) -> DataFrame:
    if isinstance(forest, float):
        return featured.withColumn("probability", F.lit(forest))
    scored = forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured))
    return scored.withColumn("p", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "features").withColumnRenamed("p", "probability")


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """doc_id, nth, secret, secret_sha256, length, probability, is_secret of every candidate."""
    return _scanned(docs, labelled, path, threshold).drop("text_hash")


def _scanned(docs: DataFrame, labelled: DataFrame | None, path: str | None, threshold: float = 0.5) -> DataFrame:
    featured = stored(with_features(findings(docs, path)), like="findings")
    scored = with_probability(featured, fit(featured, docs, labelled))
    return scored.select("doc_id", "text_hash", "nth", "secret", F.sha2("secret", 256).alias("secret_sha256"), F.col("length").cast("long").alias("length"), F.round("probability", 6).alias("probability"), (F.col("probability") >= threshold).alias("is_secret"))


def redact_secrets(docs: DataFrame, labelled: DataFrame | None = None, path: str | None = "source") -> DataFrame:
    """``docs`` with every secret replaced, where it was found, by ``<SECRET>``, and ``n_chars``, if there, set anew.

    Rows without a candidate pass untouched and unshuffled; only rows with findings are joined to them."""
    suspect = _suspect(F.col("text"))
    found = _scanned(docs, labelled, path).where("is_secret").groupBy(F.col("doc_id").alias("of"), F.col("text_hash").alias("hash")).agg(F.collect_set("nth").alias("nth"))
    # packed, so that a column of any name is no other one
    row, text = F.col("row"), F.col("row").getField("text")
    hit = docs.where(suspect).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    hit = hit.join(found, hit["row"].getField("doc_id").eqNullSafe(found["of"]) & (F.xxhash64(hit["row"].getField("text")) == found["hash"]), "left")
    match, around = _cut(text)
    piece = lambda m, i: F.concat(F.get(around, i), F.when(F.array_contains("nth", i + 1), F.concat(_lead(m), F.lit(REDACTED))).otherwise(m))
    cleaned = F.concat(F.array_join(F.transform(match, piece), ""), F.element_at(around, -1))
    hit = hit.withColumn("cleaned", F.when(F.col("nth").isNotNull(), cleaned).otherwise(text))
    now = {c: row.getField(c) for c in docs.columns} | {"text": F.col("cleaned")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        now["n_chars"] = F.when(F.col("nth").isNotNull(), F.length("cleaned").cast(kind)).otherwise(row.getField("n_chars"))
    return docs.where(~suspect).unionByName(hit.select(*(v.alias(c) for c, v in now.items())))
