"""Secret scans: candidates by pattern, false positives removed by a random forest.

Everything here is DataFrame functions and ``pyspark.ml``.

*Candidates* are runs of at least ``MIN_LENGTH`` characters of ``[A-Za-z0-9+/_=-]``
that hold a digit, one of ``+/_=`` or a capital after a small letter.  Only
texts that hold one are taken apart.

*Corpus statistics* come from the words of all texts, counted once: the
``DICTIONARY`` most frequent words of letters, and how likely one letter is
after another.

*Features* of a candidate: its length and kinds of characters, how often the
kind changes and how likely its letter transitions are, how much of it
dictionary words cover, whether it stands in a path, URL or address, and which
words, signs and quotes stand around it.

*The forest* is trained on labelled findings: a frame with the columns of
``FINDING`` and ``label``, by default ``labelled_findings``, which writes
``TRAINING`` of them from the table's own dictionary: keys and tokens beside
placeholders, check sums, identifiers, numbers, paths and glued words.

A null text is empty and holds no candidate; very long texts are taken whole;
repeated rows give repeated findings.  Empty tables give no findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqyield.llm.common import most_frequent, stored, whole

MIN_LENGTH = 16
DICTIONARY = 8192
TRAINING = 6000
TREES, DEPTH = 30, 7

_RUN = "[A-Za-z0-9+/_=-]"
#: Starts where no run character precedes; needs a digit, a sign or an inner capital.
CANDIDATE = (rf"(?<!{_RUN})(?=[A-Za-z-]*+[0-9+/_=]|[A-Z-]*+[a-z-]++[A-Z]){_RUN}{{{MIN_LENGTH},}}+")

# Words that name a secret, and words that name something that only looks like one.
SECRET_WORDS = ("token secret password passwd pwd apikey api key auth authorization credential credentials bearer "
                "private access session signature").split()
HARMLESS_WORDS = ("commit sha sha1 sha256 md5 hash checksum digest uuid guid id revision rev version build etag ref "
                  "file image card phone number isbn order invoice example sample placeholder test dummy").split()
#: What describes a finding: the run, the part of its word before it, the words before, the one after.
FINDING = ["candidate", "prefix", "before", "after"]


def _words(text: Column) -> Column:
    return F.split(text, r"[\x20\x09-\x0D]")


#: Words whose lengths are summed up together.
BLOCK = 256


def _bound(value: Column, use) -> Column:
    """``use(value)``, the value computed once, however often ``use`` reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _word_findings(words: Column) -> Column:
    """For each word that holds a candidate: its number, offset (code points), text and neighbours.

    Lengths are summed by blocks of words once a text; a candidate then adds the words of its own block, so the
    time does not grow with words times candidates.
    """
    length = lambda w, i: F.char_length(F.get(w, i)).cast("long") + 1
    total = lambda w, lo, hi: F.aggregate(F.sequence(lo, hi), F.lit(0).cast("long"),
                                          lambda n, i: n + length(w, i))

    def placed(w, heads):
        hits = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).rlike(CANDIDATE))
        return F.transform(hits, lambda i: F.struct(
            i.alias("word"),
            (F.get(heads, F.floor(i / BLOCK).cast("int")) + total(w, (F.floor(i / BLOCK) * BLOCK).cast("int"), i)
             - length(w, i)).alias("offset"),
            F.get(w, i).alias("text"), F.concat_ws(" ", *[F.get(w, i - k) for k in (3, 2, 1)]).alias("before"),
            F.coalesce(F.get(w, i + 1), F.lit("")).alias("after")))

    def with_heads(w):
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / BLOCK).cast("int")), lambda b: total(
            w, b * BLOCK, F.least(b * BLOCK + (BLOCK - 1), F.size(w) - 1)))
        heads = _bound(sums, lambda s: F.transform(s, lambda _, b: F.aggregate(
            F.slice(s, F.lit(1), b), F.lit(0).cast("long"), lambda n, x: n + x)))
        return _bound(heads, lambda h: placed(w, h))

    return _bound(words, with_heads)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per candidate: id, word (its number), start (code points), and ``FINDING``."""
    held = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).where(F.col("text").rlike(CANDIDATE))
    near = held.select("id", F.explode(_word_findings(_words(F.col("text")))).alias("near")).select("id", "near.*")
    # What stands between the candidates of a word gives each its own place, also where one occurs twice.
    cut = near.withColumns({"found": F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)),
                            "between": F.split("text", CANDIDATE, -1)})
    ahead = F.transform("found", lambda x, i: F.char_length(F.get("between", i)) + F.when(
        i > 0, F.char_length(F.get("found", i - 1))).otherwise(0))
    each = cut.withColumn("ahead", ahead).select("*", F.posexplode("found").alias("number", "candidate"))
    at = F.aggregate(F.slice("ahead", F.lit(1), F.col("number") + 1), F.lit(0), lambda n, x: n + x)
    return each.withColumn("at", at).select(
        "id", "word", (F.col("offset") + F.col("at")).alias("start"), "candidate",
        F.substring("text", F.lit(1), F.col("at")).alias("prefix"), "before", "after")


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of all words of all texts, in lower case."""
    return (docs.select(F.explode(F.split(F.lower(whole(text_col)), r"[^\p{L}]+")).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("word <> ''"))


def letter_transitions(counts: DataFrame) -> DataFrame:
    """(pair, likely): log of how often the second of two letters follows the first; at most 26 x 26 rows."""
    pairs = counts.where(F.col("word").rlike("^[a-z]{2,}$")).select(
        "n", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1),
                                   lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("pair"))
    summed = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    first = summed.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("n").alias("all"))
    return summed.join(F.broadcast(first), F.substring("pair", 1, 1) == F.col("first")).select(
        "pair", F.log((F.col("n") + 0.5) / (F.col("all") + 13.0)).alias("likely"))


def dictionary(counts: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """(word, rank) of the most frequent words of three or more letters, ``size`` at most."""
    top = most_frequent(counts.where(F.char_length("word") >= 3), "n", size)
    ordered = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("all"))
    return ordered.select(F.posexplode("all").alias("rank", "x")).select("x.word", "rank")


#: What an unseen letter transition counts as.
UNSEEN = -9.0
FEATURES = ["length", "digits", "capitals", "small", "signs", "hexadecimal", "distinct", "changes", "likely", "letters",
            "covered", "slashes", "in_url", "in_address", "named", "harmless", "assigned", "quoted", "named_inside",
            "harmless_inside", "prose_after"]


def features(found: DataFrame, words: DataFrame, transitions: DataFrame) -> DataFrame:
    """``found`` (with the columns ``FINDING``) and the columns ``FEATURES``."""
    c, n = F.col("candidate"), F.char_length("candidate").cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    context = F.lower(F.concat_ws(" ", "before", "prefix"))
    around = F.lower(F.concat_ws(" ", "before", "prefix", "after"))
    one_of = lambda names: "(?:^|[^a-z0-9])(?:" + "|".join(names) + ")(?:$|[^a-z0-9])"
    flag = lambda condition: condition.cast("double")
    # Each distinct candidate is looked up once, in tables of fixed size.
    texts = found.select("candidate").distinct()
    runs = texts.select("candidate", F.explode_outer(F.filter(
        F.split(F.lower(F.regexp_replace("candidate", r"(?<=[a-z])(?=[A-Z])", " ")), "[^a-z]+"),
        lambda x: F.char_length(x) >= 3)).alias("word"))
    covered = runs.join(F.broadcast(words.select("word", F.lit(True).alias("known"))), "word", "left").groupBy("candidate").agg(
        F.sum(F.when(F.col("known"), F.char_length("word")).otherwise(0)).alias("known_letters"))
    lowered = F.lower("candidate")
    pairs = texts.select("candidate", F.explode(F.transform(
        F.sequence(F.lit(1), F.char_length("candidate") - 1), lambda i: F.substring(lowered, i, F.lit(2)))).alias("pair"))
    pairs = pairs.where(F.col("pair").rlike("^[a-z]{2}$"))
    likely = pairs.join(F.broadcast(transitions), "pair", "left").groupBy("candidate").agg(
        F.avg(F.coalesce("likely", F.lit(UNSEEN))).alias("likely_mean"))
    return (found.join(covered, "candidate", "left").join(likely, "candidate", "left").withColumns({
        "length": n, "digits": share("[0-9]"), "capitals": share("[A-Z]"), "small": share("[a-z]"),
        "signs": share("[+/_=-]"), "hexadecimal": flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "distinct": F.size(F.array_distinct(F.split("candidate", ""))) / n,
        "changes": share("[a-z](?=[A-Z0-9])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])|[A-Za-z0-9](?=[+/_=-])"),
        "likely": F.coalesce("likely_mean", F.lit(UNSEEN)), "letters": share("[A-Za-z]{4,}"),
        "covered": F.coalesce("known_letters", F.lit(0)) / n, "slashes": share("/"),
        "in_url": flag(context.rlike(r"(?:https?:|www\.|\.(?:com|org|net|html?|png|jpe?g)|[./~]/)[^ ]*$")),
        "in_address": flag(F.concat(F.col("prefix"), F.col("candidate"), F.col("after")).rlike("@")),
        "named": flag(context.rlike(one_of(SECRET_WORDS))), "harmless": flag(around.rlike(one_of(HARMLESS_WORDS))),
        "assigned": flag(context.rlike(r"[=:]\s*[\"'`]?$")), "quoted": flag(F.col("prefix").rlike("[\"'`]$")),
        "named_inside": flag(lowered.rlike("|".join(SECRET_WORDS))),
        "harmless_inside": flag(lowered.rlike("your|example|sample|placeholder|test|here|xxx|changeme")),
        "prose_after": flag(F.col("after").rlike(r"^\p{L}+[.,;]?$")),
    }).drop("known_letters", "likely_mean"))


def labelled_findings(spark: SparkSession, words: DataFrame, count: int = TRAINING) -> DataFrame:
    """``count`` labelled findings (``FINDING`` and label), written from the dictionary ``words``."""
    size = words.count()
    listed = F.broadcast(words.select(F.col("word").alias("known"), F.col("rank").alias("at")))
    rows = spark.range(count)
    # Four words of the dictionary for each row; without a dictionary the row's number stands in.
    for k in range(4):
        pick = F.pmod(F.xxhash64("id", F.lit(k)), F.lit(max(size, 1)))
        rows = rows.withColumn("pick", pick).join(listed, F.col("pick") == F.col("at"), "left").withColumn(
            f"word{k}", F.coalesce("known", F.concat(F.lit("word"), F.col("id").cast("string")))).drop("pick", "known", "at")
    w = [F.col(f"word{k}") for k in range(4)]
    draw = lambda name, k: F.element_at(F.array(*[F.lit(x) for x in name]),
                                        (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(name))) + 1).cast("int"))
    text = F.col("id").cast("string")
    hex_ = F.sha2(text, 256)
    plain = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(text, F.lit("b")), 512))), "[+/=]", "")
    cut = lambda x, sizes, k: F.substring(x, F.lit(1), draw(sizes, k))
    key = draw(SECRET_WORDS, 11)
    random = F.when(F.pmod(F.xxhash64("id", F.lit(12)), F.lit(2)) == 0, cut(hex_, (24, 32, 40, 48, 64), 13)).otherwise(
        cut(plain, (20, 24, 32, 40, 64), 13))
    digits = F.substring(F.concat(F.conv(F.substring(hex_, 1, 12), 16, 10), F.conv(F.substring(hex_, 13, 12), 16, 10)), 1, 16)
    uuid = F.concat_ws("-", *[F.substring(hex_, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    quote, sign, none = draw(['"', "'", ""], 14), draw(["=", ":"], 15), F.lit("")
    prose, glued = F.concat_ws(" ", *w[:3]), F.concat(F.initcap(w[0]), F.initcap(w[1]), F.initcap(w[2]), F.lit("7"))
    slug = F.translate(F.concat_ws(" ", *w, F.lit("2")), " ", "_")
    slug = F.when(F.pmod(F.xxhash64("id", F.lit(16)), F.lit(2)) == 0, slug).otherwise(F.translate(slug, "_", "-"))
    # (candidate, prefix, before, after, label)
    kinds = [
        (random, quote, F.concat_ws(" ", w[0], key, sign), w[3], 1),
        (random, F.concat(key, sign, quote), F.concat_ws(" ", w[0], w[1], w[2]), w[3], 1),
        (random, none, F.concat_ws(" ", w[0], F.concat(key, F.lit(":")), F.lit("Bearer")), none, 1),
        (F.concat(draw(["sk_live_", "ghp_", "AKIA", "xoxb-"], 17), plain), quote, F.concat_ws(" ", w[0], w[1], w[2]), w[3], 1),
        (F.concat_ws("_", F.lit("your"), key, w[0], F.lit("here")), quote, F.concat_ws(" ", w[0], key, sign), w[3], 0),
        (random, none, F.concat_ws(" ", w[0], w[1], draw(HARMLESS_WORDS[:17], 18)), w[3], 0),
        (digits, none, prose, w[3], 0),
        (slug, F.concat(F.lit("https://www."), w[0], F.lit(".com/")), F.concat_ws(" ", w[1], w[2]), w[3], 0),
        (uuid, none, F.concat_ws(" ", w[0], w[1], draw(["uuid", "id", "guid", "order"], 19)), w[3], 0),
        (F.when(F.pmod("id", F.lit(20)) < 10, glued).otherwise(slug), none, prose, w[3], 0),
    ]
    kind = F.pmod("id", F.lit(len(kinds)))
    choose = lambda i: F.coalesce(*[F.when(kind == k, row[i]) for k, row in enumerate(kinds)])
    label = F.coalesce(*[F.when(kind == k, F.lit(float(row[4]))) for k, row in enumerate(kinds)])
    return rows.select(choose(0).alias("candidate"), choose(1).alias("prefix"), choose(2).alias("before"),
                       choose(3).alias("after"), label.alias("label")).where(F.char_length("candidate") >= MIN_LENGTH)


def _assembled(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)


def fit(labelled: DataFrame, words: DataFrame, transitions: DataFrame, trees: int = TREES,
        depth: int = DEPTH, seed: int = 5) -> RandomForestClassificationModel:
    """Train the forest on labelled findings."""
    rows, _ = stored(features(labelled, words, transitions).select(*FEATURES, "label"), "labelled-findings")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird")
    return forest.fit(_assembled(rows))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None,
         threshold: float = 0.5) -> DataFrame:
    """A row per candidate: id_col, start, length, candidate, score, is_secret."""
    spark = docs.sparkSession
    counts, _ = stored(word_counts(docs, text_col), "words")
    words, _ = stored(dictionary(counts), "dictionary")
    transitions, _ = stored(letter_transitions(counts), "transitions")
    model = fit(labelled if labelled is not None else labelled_findings(spark, words), words, transitions)
    found, _ = stored(candidates(docs, id_col, text_col), "candidates")
    scored = model.transform(_assembled(features(found, words, transitions)))
    score = vector_to_array("probability")[1]
    return scored.select(F.col("id").alias(id_col), "start", F.char_length("candidate").alias("length"), "candidate",
                         score.alias("score"), (score >= threshold).alias("is_secret"))
