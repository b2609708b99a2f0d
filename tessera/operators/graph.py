"""Entities, relations, the chunk graph and its co-occurrence store (S5).

Loops over pairs of chunks become equi-joins on the entity; pairs that share nothing are never formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

PHRASE = r"(?<![\p{L}\p{N}_])[A-ZÀ-Ÿ][a-zà-ÿ]+(?:(?U:\s)+[A-ZÀ-Ÿ][a-zà-ÿ]+){0,4}(?![\p{L}\p{N}_])"
# Verbs that relate two entities of a sentence.
VERBS = "is has uses owns acquired manages contains supports reports causes".split()


# First words that begin no entity: words that open sentences, and nouns of headings.
BLOCKED = (
    "The This That These Those When Where What Which However Therefore Moreover Furthermore Although Because "
    "Since While Both Each Some Many Most Such Here There Thus Hence Also But And Or Yet "
    "Les Des Une Dans Pour Que Est Sur Par Avec Aux Cette Leur Leurs Dont Ainsi Lorsque Lorsqu "
    "Sont Ont Peut Doit Doivent Toute Tout Tous Selon Sous Entre Après Avant Sans Même Plus "
    "Lors Afin Sauf Quant Comme Bien Soit Seul Seule Seuls Seules Tel Tels Telle Telles "
    "Aucun Aucune Chaque Plusieurs Elles Nous Vous Notamment Respectivement Également "
    "Champ Application Objet Portée Effets Entrée Vigueur Dénonciation Ratification Protocole Annexe Amendement "
    "Income Interest Royalties Object Scope Entry Force Termination"
).split()
#: Nouns of headings that are blocked in both numbers.
BLOCKED_NOUNS = (
    ("Personne", "s"), ("Revenu", "s"), ("Impôt", "s"), ("Résident", "s"), ("Société", "s"), ("Bénéfice", "s"), ("Dividende", "s"), ("Intérêt", "s"),
    ("Redevance", "s"), ("Salaire", "s"), ("Pension", "s"), ("Rémunération", "s"), ("Élément", "s"), ("Définition", "s"), ("Disposition", "s"), ("Entreprise", "s"),
    ("Établissement", "s"), ("Service", "s"), ("Person", "s"), ("Tax", "es"), ("Resident", "s"), ("Dividend", "s"), ("Benefit", "s"), ("Provision", "s"),
)
BLOCKED_PAIRS = ("Company", "Companies", "Salary", "Salaries")


def blocked() -> list[str]:
    """First words that begin no entity."""
    return sorted({*BLOCKED, *BLOCKED_PAIRS, *(n for noun, end in BLOCKED_NOUNS for n in (noun, noun + end))})


def entities(chunks: DataFrame, most: int = 30, blocklist: list[str] | None = None) -> DataFrame:
    """chunks(doc_id, idx, text) -> (doc_id, idx, pos, text, label, canonical, entity_id, parent_id): capitalised phrases of up to
    five words and more than three characters, first occurrences only, at most `most` a chunk. Single words that begin a text or
    follow a sentence end are left out."""
    marked = F.regexp_replace(F.col("text"), F.lit(PHRASE), F.lit("\x01$0\x02"))
    parts = F.split(marked, "[\x01\x02]", -1)
    placed = chunks.select("doc_id", "idx", F.posexplode(parts).alias("k", "part"), parts.alias("parts")).filter("k % 2 = 1")
    before = F.element_at("parts", F.col("k"))
    starts = before.rlike(r"(?U)[.!?\n]\s+$") | ((F.col("k") == 1) & (before == ""))
    first = F.element_at(F.split("part", r"(?U)\s+"), 1)
    single = F.size(tx.words(F.col("part"))) == 1
    stop = F.array(*[F.lit(w) for w in (blocklist if blocklist is not None else blocked())])
    kept = placed.filter((F.length("part") > 3) & ~F.array_contains(stop, first) & ~(starts & single))
    lower = F.lower("part")
    once = kept.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "idx", lower).orderBy("k"))).filter("r = 1")
    ranked = once.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id", "idx").orderBy("k"))).filter(F.col("pos") <= most)
    return canonical(ranked.select("doc_id", "idx", F.col("pos").cast("long").alias("pos"), F.col("part").alias("text"), F.lit("ENTITY").alias("label")))


def canonical(found: DataFrame) -> DataFrame:
    """Adds canonical form, entity_id and parent_id (the label with the whole form, and with its last word)."""
    form = F.replace(F.replace(F.regexp_replace(F.lower("text"), r"(?U)\s+", " "), F.lit("inc."), F.lit("inc")), F.lit("corp."), F.lit("corp"))
    return found.withColumn("canonical", form).withColumns({
        "entity_id": F.concat_ws("::", "label", "canonical"), "parent_id": F.concat_ws("::", "label", F.element_at(F.split("canonical", " "), -1)),
    })


def relations(chunks: DataFrame, ents: DataFrame, most: int = 30) -> DataFrame:
    """(doc_id, idx, subject, relation, object): for every sentence with a verb, each entity in it with the first other one."""
    parts = F.filter(F.transform(F.split("text", r"(?U)(?<=[.!?])\s+"), tx.strip), lambda x: x != "")
    verb = F.regexp_extract(F.lower("s"), r"(?<![\p{L}\p{N}_])(" + "|".join(VERBS) + r")(?![\p{L}\p{N}_])", 1)
    sentences = chunks.select("doc_id", "idx", F.posexplode(parts).alias("sent", "s")).withColumn("relation", verb).filter("relation <> ''")
    inside = sentences.join(ents.select("doc_id", "idx", "pos", F.col("text").alias("e")), ["doc_id", "idx"]).filter(F.contains(F.lower("s"), F.lower("e")))
    by_sentence = Window.partitionBy("doc_id", "idx", "sent").orderBy("pos")
    placed = inside.withColumns({"r": F.row_number().over(by_sentence), "head": F.first("e").over(by_sentence), "second": F.nth_value("e", 2).over(by_sentence.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    made = placed.withColumn("object", F.when(F.col("r") == 1, F.col("second")).otherwise(F.col("head"))).filter("object is not null")
    once = made.withColumn("u", F.row_number().over(Window.partitionBy("doc_id", "idx", "e", "relation", "object").orderBy("sent", "pos"))).filter("u = 1")
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "idx").orderBy("sent", "pos"))).filter(F.col("n") <= most)
    return ranked.select("doc_id", "idx", F.col("e").alias("subject"), "relation", "object")


def edges(ents: DataFrame, rels: DataFrame | None = None, prior: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, target, weight, types) of chunks that share entities or related pairs, or whose entities the store has
    seen together: prior(a, b, cnt)."""
    kinds = ents.select("doc_id", "idx", F.col("canonical").alias("k")).distinct()
    pair = lambda df, name: df.alias("x").join(df.alias("y"), (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.idx") < F.col("y.idx"))).select("x.doc_id", F.col("x.idx").alias("source"), F.col("y.idx").alias("target"), F.lit(1).alias("w"), F.lit(name).alias("type"))
    found = pair(kinds, "shared_entity")
    if rels is not None:
        pairs = rels.select("doc_id", "idx", F.concat_ws("\x01", F.lower("subject"), F.lower("object")).alias("k")).distinct()
        found = found.unionByName(pair(pairs, "relation_bridge"))
    if prior is not None:
        left, right = (kinds.select("doc_id", F.col("idx").alias(i), F.col("k").alias(k)) for i, k in (("source", "a"), ("target", "b")))
        met = left.join(prior, "a").join(right, ["doc_id", "b"]).filter("source < target")
        found = found.unionByName(met.select("doc_id", "source", "target", F.col("cnt").cast("int").alias("w"), F.lit("kg_prior").alias("type")))
    return found.groupBy("doc_id", "source", "target").agg(F.sum("w").alias("weight"), F.array_sort(F.collect_set("type")).alias("types"))


def cooccurrence(ents: DataFrame) -> DataFrame:
    """(a, b, cnt): how often two entities stand in one chunk, both ways. A chunk's entities go to each one's group once, as the text of
    those that follow it in order, so that a pair is shuffled as one word and is counted where its first entity is; the other way round is
    added last. Most pairs occur once, so groups are dealt out to more tasks than the session has partitions."""
    held = ents.groupBy("doc_id", "idx").agg(F.array_sort(F.collect_set("canonical")).alias("k"))
    return pair_counts(held)


def pair_counts(held: DataFrame) -> DataFrame:
    """The same of held(k): the distinct entities of every chunk, in order."""
    tasks = 8 * int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = held.filter(F.size("k") > 1).select("k", F.posexplode("k").alias("i", "a")).filter(F.col("i") < F.size("k") - 1)
    sent = each.select("a", F.array_join(F.slice("k", F.col("i") + 2, F.size("k")), "\x01").alias("rest")).repartition(tasks, "a")
    counts = sent.select("a", F.explode(F.split("rest", "\x01", -1)).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("cnt"))
    ways = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return counts.select(F.explode(ways).alias("p"), "cnt").select("p.a", "p.b", "cnt")


def upsert(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """A new version of the co-occurrence store with fresh counts added."""
    return store.unionByName(fresh).groupBy("a", "b").agg(F.sum("cnt").alias("cnt"))


def chunk_index(ents: DataFrame, run: str, sequence: int) -> DataFrame:
    """(entity, chunk, sequence): which chunks of a run hold an entity; later runs have greater sequence numbers."""
    chunk = F.concat(F.lit(run + "::"), F.col("doc_id").cast("string"), F.lit("::C"), F.col("idx").cast("string"))
    return ents.select(F.col("canonical").alias("entity"), chunk.alias("chunk"), F.lit(sequence).cast("long").alias("sequence")).distinct()


def save_store(path: str, pairs: DataFrame, index: DataFrame, most: int = 500) -> None:
    """Writes a new version of the store: pairs(a, b, cnt), and of every entity the last `most` chunks. The version's number is the
    folder's name, so a reader of the one before isn't disturbed, and a run that breaks off leaves none."""
    newest = Window.partitionBy("entity").orderBy(F.desc("sequence"), F.desc("chunk"))
    kept = index.withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= most).drop("r")
    version = len(store_versions(pairs.sparkSession, path))
    pairs.write.parquet(f"{path}/pairs/version={version}")
    kept.write.parquet(f"{path}/index/version={version}")


def store_versions(spark, path: str) -> list[int]:
    """Versions whose both tables are complete."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs, found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), []
    at = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    while all(fs.exists(at(f"{path}/{t}/version={len(found)}/_SUCCESS")) for t in ("pairs", "index")):
        found.append(len(found))
    return found


def load_store(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, index) of the newest version; empty tables where there is none."""
    versions = store_versions(spark, path)
    pairs, index = "a string, b string, cnt bigint", "entity string, chunk string, sequence bigint"
    if not versions:
        return spark.createDataFrame([], pairs), spark.createDataFrame([], index)
    return tuple(spark.read.schema(s).parquet(f"{path}/{t}/version={versions[-1]}") for t, s in (("pairs", pairs), ("index", index)))


def neighbour_means(edge: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc_id, idx, vector): the weighted mean of the neighbours' vectors(doc_id, idx, vector)."""
    both = edge.select("doc_id", F.col("source").alias("idx"), F.col("target").alias("n"), "weight").unionByName(edge.select("doc_id", F.col("target").alias("idx"), F.col("source").alias("n"), "weight"))
    met = both.join(vectors.select("doc_id", F.col("idx").alias("n"), "vector"), ["doc_id", "n"])
    spread = met.select("doc_id", "idx", "weight", F.posexplode("vector").alias("d", "v")).groupBy("doc_id", "idx", "d").agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("m"))
    return spread.groupBy("doc_id", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda x: x["m"]).alias("vector"))


def topic(text: Column) -> Column:
    """A heading, else the first sentence of four words or more among three, at most 80 characters."""
    heading = F.regexp_extract(text, r"(?md)^#{1,3}\s+(.+)$", 1)
    good = F.filter(F.slice(F.transform(F.split(tx.strip(text), r"(?U)(?<=[.!?])\s+"), tx.strip), 1, 3), lambda s: F.size(tx.words(s)) >= 4)
    return F.when(heading != "", F.substr(tx.strip(heading), F.lit(1), F.lit(80))).when(F.size(good) > 0, F.substr(F.element_at(good, 1), F.lit(1), F.lit(80))).otherwise("the provided content")
