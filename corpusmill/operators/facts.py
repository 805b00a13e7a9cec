"""Subject-relation-object facts from sentences, votes between sources, chains, and questions answered from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import fixed as K
from corpusmill.functions import text as T
from corpusmill.operators.store import stored

FACT = "struct<subject:string,relation:string,object:string>"

#: The sentence patterns, in the order they are tried: name, pattern, groups of subject, relation (0: the name) and object.
JAPANESE = (
    ("definition", rf"{K.LEAD_IN}{K.SUBJECT}\s*とは、?\s*{K.OBJECT}\s*(?:のこと)?(?:である|です|を指す|をいう|と呼ばれる)[。.]?$", 1, 0, 2),
    ("attr", rf"{K.LEAD_IN}{K.SUBJECT}\s*の\s*({K.ATTRIBUTE})\s*は、?\s*{K.OBJECT}\s*(?:である|です|だ|になる|となる)?[。.]?$", 1, 2, 3),
    ("is", rf"{K.LEAD_IN}{K.SUBJECT}\s*は、?\s*{K.OBJECT}\s*(?:である|です|だ)[。.]?$", 1, 0, 2),
    ("location", rf"{K.LEAD_IN}{K.SUBJECT}\s*は、?\s*{K.OBJECT}\s*(?:に位置する|にある|に属する)[。.]?$", 1, 0, 2),
    ("event", rf"{K.LEAD_IN}{K.SUBJECT}\s*は、?\s*([0-9]{{3,4}}\s*年[^、。]{{0,12}}?)\s*に\s*(.{{1,30}}?(?:された|した|生まれた|設立|創業|発明|完成|開業|公開))[。.]?$", 1, 0, 2),
)
ENGLISH = (
    ("definition", rf"(?i)^(?:the\s+)?{K.SUBJECT}\s+(?:is|are|was|were)\s+(?:an?|the)\s+{K.OBJECT}[.]?$", 1, 0, 2),
    ("attr", rf"(?i)^(?:the\s+)?([a-z][a-z ]{{1,20}}?)\s+of\s+(?:the\s+)?{K.SUBJECT}\s+(?:is|are|was|were)\s+{K.OBJECT}[.]?$", 2, 1, 3),
    ("attr2", rf"(?i)^{K.SUBJECT}'s\s+([a-z][a-z ]{{1,20}}?)\s+(?:is|are|was|were)\s+{K.OBJECT}[.]?$", 1, 2, 3),
    ("event", rf"(?i)^{K.SUBJECT}\s+(?:was|were)\s+(founded|born|built|established|invented|created|released|discovered)\s+(?:in|on)\s+{K.OBJECT}[.]?$", 1, 2, 3),
)
PLACED = r"(?:に位置する|にある|にあります|に属する)$"
PARTICLES = "[のがはをにでと]"

# The question patterns.
JA_ATTRIBUTE_QUESTION = rf"^{K.SUBJECT}\s*の\s*({K.ATTRIBUTE})\s*(?:は|って|を教えて|は何|はどこ|はいつ|はどれくらい|はいくつ)?[?？]?\s*(?:何|なに|どこ|いつ|誰|だれ|どれくらい|いくつ|教えて)?(?:ですか|でしょうか|か)?[?？。]*$"
JA_WH_QUESTION = rf"^{K.SUBJECT}\s*(?:は|が|って)\s*(?:一体)?(いつ|どこ|誰|だれ|何処)"
JA_DEFINITION_QUESTION = rf"^{K.SUBJECT}\s*(?:とは|って|とは何|って何|ってなに|とはなに|について教えて|を教えて|とは何ですか|って何ですか)[?？。]*$"
EN_ATTRIBUTE_QUESTION = rf"(?i)^(?:what|when|where|who)\s+(?:is|are|was|were)\s+(?:the\s+)?([a-z][a-z ]{{1,20}}?)\s+of\s+(?:the\s+)?{K.SUBJECT}\s*[?]?$"
EN_DEFINITION_QUESTION = rf"(?i)^(?:what|who)\s+(?:is|are|was|were)\s+(?:an?\s+|the\s+)?{K.SUBJECT}\s*[?]?$"


def may_state_fact(t: Column) -> Column:
    """A cheap test before the patterns: an English verb of being, or a Japanese sentence end that states something."""
    ascii_only = t.rlike(r"^[\x00-\x7F]*$")
    return F.length(t).between(6, 200) & F.when(ascii_only, t.rlike(K.EN_VERB)).otherwise(F.substring(t, -14, 14).rlike(K.JA_TAIL))


def _checked(subject: Column, relation: Column, object_: Column, found: Column) -> Column:
    """The fact, if its operands are good ones."""
    topic = T.is_phrase(F.lower(subject)) | F.exists(T.keywords(subject, 2), T.is_phrase)
    good = found & (subject != "") & ~subject.rlike(K.BAD_SUBJECT) & F.length(object_).between(2, 80) & topic
    return F.when(good, F.struct(subject.alias("subject"), relation.alias("relation"), object_.alias("object")))


def _candidate(s: Column, kind: str, pattern: str, subject: int, relation: int, object_: int, japanese: bool) -> Column:
    part = lambda i: T.clean_operand(F.regexp_extract(s, pattern, i))
    found, subj, obj = s.rlike(pattern), T.strip(part(subject)), part(object_)
    rel = F.lower(part(relation)) if relation and not japanese else part(relation) if relation else F.lit(kind)
    if japanese:
        # a subject right after a particle is an attribute of something else
        before = F.substr(s, F.lit(1), F.instr(s, F.regexp_extract(s, pattern, subject)) - 1)
        found = found & ~before.rlike(f"{PARTICLES}$")
        if kind == "attr":
            placed = obj.rlike(PLACED)
            rel = F.when(placed & rel.isin("場所", "所在地", "位置"), "location").otherwise(rel)
            obj = F.regexp_replace(obj, PLACED, "")
        if kind == "event":
            obj = F.concat(obj, F.lit("に"), part(3))
    return _checked(subj, rel, obj, found)


def extract(t: Column) -> Column:
    """The one fact that a sentence states, or null: the first pattern whose operands are good."""
    s = T.normalize(t)
    english = F.coalesce(*[_candidate(s, *p, japanese=False) for p in ENGLISH])
    japanese = F.coalesce(*[_candidate(s, *p, japanese=True) for p in JAPANESE])
    return F.when(may_state_fact(s), F.when(s.rlike(r"^[\x00-\x7F]*$"), english).otherwise(japanese))


def facts(rows: DataFrame) -> DataFrame:
    """seq, source, subject_key, subject, relation, object of numbered sentences; sentences that cannot state one go first."""
    some = rows.where(may_state_fact(F.col("text"))).select("seq", "source", extract(F.col("text")).alias("f")).where("f is not null")
    some = stored(some, "facts")  # few of the sentences
    return some.select("seq", "source", T.subject_key("f.subject").alias("subject_key"), "f.subject", "f.relation", "f.object")


def parse_question(t: Column) -> Column:
    """struct<subject,relation>, or null."""
    s = T.normalize(t)
    of = lambda cond, subject, relation: F.when(cond & (subject != ""), F.struct(subject.alias("subject"), relation.alias("relation")))
    group = lambda p, i: F.regexp_extract(s, p, i)
    english = F.coalesce(
        of(s.rlike(EN_ATTRIBUTE_QUESTION), T.clean_operand(group(EN_ATTRIBUTE_QUESTION, 2)), T.strip(F.lower(group(EN_ATTRIBUTE_QUESTION, 1)))),
        of(s.rlike(EN_DEFINITION_QUESTION), T.clean_operand(group(EN_DEFINITION_QUESTION, 1)), F.lit("definition")),
    )
    attribute = F.regexp_replace(group(JA_ATTRIBUTE_QUESTION, 2), "(は誰|はいつ|はどこ|は何|はなに|は|って|を)$", "")
    parts = F.filter(F.split(attribute, "の"), lambda x: x != "")
    chained = F.size(parts) >= 2
    head = T.clean_operand(group(JA_ATTRIBUTE_QUESTION, 1))
    whole = F.when(chained, F.concat(head, F.lit("の"), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "の"))).otherwise(head)
    relation = F.when(chained, F.element_at(parts, -1)).otherwise(attribute)
    kind = F.when(group(JA_WH_QUESTION, 2) == "いつ", "event").when(group(JA_WH_QUESTION, 2).isin("どこ", "何処"), "location").otherwise("who")
    fit = lambda p: s.rlike(p) & ~group(p, 1).rlike(K.BAD_SUBJECT)
    japanese = F.coalesce(
        of(fit(JA_ATTRIBUTE_QUESTION) & (relation != ""), whole, relation),
        of(fit(JA_WH_QUESTION), T.clean_operand(group(JA_WH_QUESTION, 1)), kind),
        of(fit(JA_DEFINITION_QUESTION), T.clean_operand(group(JA_DEFINITION_QUESTION, 1)), F.lit("definition")),
    )
    return F.when(s.rlike(r"^[\x00-\x7F]*$"), english).otherwise(japanese)


def support(found: DataFrame) -> DataFrame:
    """subject_key, relation, claim, sources, sentences, first_seq, rank: equal claims put together, best supported first."""
    claim = F.lower(F.regexp_replace("object", r"[\s、,。.]", ""))
    groups = found.groupBy("subject_key", "relation", claim.alias("claim")).agg(F.countDistinct("source").alias("sources"), F.count(F.lit(1)).alias("sentences"), F.min("seq").alias("first_seq"))
    w = Window.partitionBy("subject_key", "relation").orderBy(F.desc("sources"), F.desc("sentences"), "first_seq")
    return groups.withColumn("rank", F.row_number().over(w).cast("long"))


def conflicts(found: DataFrame) -> DataFrame:
    """The claims of subjects and relations with more than one."""
    ranked = support(found)
    several = ranked.where("rank = 2").select("subject_key", "relation")
    return ranked.join(several, ["subject_key", "relation"], "left_semi")


def first_of(found: DataFrame) -> DataFrame:
    """The first fact of each subject and relation."""
    return found.groupBy("subject_key", "relation").agg(F.min(F.struct("seq", "object")).alias("f")).select("subject_key", "relation", F.col("f.object").alias("object"), F.col("f.seq").alias("seq"))


def chain(asked: DataFrame, found: DataFrame, hops: int) -> DataFrame:
    """id, answer, seq: (id, subject, relations) followed through ``hops`` relations, each from the first fact."""
    one = first_of(found)
    out = asked.select("id", "relations", T.subject_key("subject").alias("subject_key"))
    for hop in range(hops):
        out = out.select("id", "relations", "subject_key", F.col("relations").getItem(hop).alias("relation")).join(one, ["subject_key", "relation"])
        out = out.select("id", "relations", T.subject_key(T.clean_operand("object")).alias("subject_key"), F.col("object").alias("answer"), "seq")
    return out.select("id", "answer", "seq")


def aliases() -> list[tuple[str, str]]:
    """Pairs of a relation as asked and one as stored that may stand for it."""
    pairs = {(w, r) for r, names in K.RELATION_ALIASES.items() for w in names}
    pairs |= {(a, b) for group in K.ATTRIBUTE_SYNONYMS for a in group for b in group if a != b}
    return sorted(pairs)


def lookup(asked: DataFrame, found: DataFrame) -> DataFrame:
    """id, tier, relation, object, seq: facts for (id, subject, relation) by the same relation, else by a synonym, else by containment."""
    table = asked.sparkSession.createDataFrame(aliases(), "asked string, stored string")
    named = F.broadcast(table.groupBy("asked").agg(F.collect_set("stored").alias("stored")))  # some hundred fixed words
    rows = asked.withColumns({"subject_key": T.subject_key("subject"), "asked": F.lower("relation")}).drop("relation").join(named, "asked", "left").join(found.select("subject_key", "relation", "object", "seq"), "subject_key")
    inside = (F.length("asked") >= 2) & ((F.instr("relation", F.col("asked")) > 0) | (F.instr(F.col("asked"), F.col("relation")) > 0))
    tier = F.when(F.col("relation") == F.col("asked"), 1).when(F.array_contains(F.coalesce("stored", T.strings()), F.col("relation")), 2).when(inside, 3)
    rows = rows.withColumn("tier", tier).where("tier is not null")
    best = Window.partitionBy("id")
    return rows.withColumn("best", F.min("tier").over(best)).where("tier = best").select("id", F.col("tier").cast("long").alias("tier"), "relation", "object", "seq")


def rendered(subject: Column, relation: Column, object_: Column, japanese: Column) -> Column:
    """A fact as a sentence in the question's language."""
    ja = F.when(relation.isin("definition", "is"), F.concat(subject, F.lit("とは、"), object_, F.lit("です。"))).when(relation == "location", F.concat(subject, F.lit("は"), object_, F.lit("にあります。"))).when(relation == "event", F.concat(subject, F.lit("は"), object_, F.lit("。"))).otherwise(F.concat(subject, F.lit("の"), relation, F.lit("は"), object_, F.lit("です。")))
    en = F.when(relation.isin("definition", "is"), F.concat_ws("", subject, F.lit(" is "), object_, F.lit("."))).when(relation == "location", F.concat(subject, F.lit(" is in "), object_, F.lit("."))).when(relation == "event", F.concat(subject, F.lit(" was "), object_, F.lit("."))).otherwise(F.concat(F.lit("The "), relation, F.lit(" of "), subject, F.lit(" is "), object_, F.lit(".")))
    return F.when(japanese, ja).otherwise(en)


def answers(asked: DataFrame, found: DataFrame) -> DataFrame:
    """id, answer: what the best supported fact says to each question (id, text), with another claim if there is one."""
    parsed = asked.select("id", "text", parse_question(F.col("text")).alias("q")).where("q is not null").select("id", "text", "q.subject", "q.relation")
    hits = lookup(parsed.select("id", "subject", "relation"), found).join(found.select("seq", "source").distinct(), "seq")
    claim = F.lower(F.regexp_replace("object", r"[\s、,。.]", ""))
    groups = hits.groupBy("id", "relation", claim.alias("claim")).agg(F.countDistinct("source").alias("sources"), F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "object")).alias("f"))
    ranked = groups.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sources"), F.desc("n"), "f.seq")))
    best = ranked.groupBy("id").agg(F.max(F.when(F.col("rank") == 1, F.struct("relation", "f.object"))).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("f.object"))).alias("other"))
    japanese = ~F.col("text").rlike(r"^[\x00-\x7F]*$")
    said = rendered(F.col("subject"), F.col("best.relation"), F.col("best.object"), japanese)
    more = F.when(F.col("other").isNull() | (F.col("other") == F.col("best.object")), "").when(japanese, F.concat(F.lit(" (別の出典では「"), "other", F.lit("」ともあります)"))).otherwise(F.concat(F.lit(" (another source says: "), "other", F.lit(")")))
    return best.join(parsed, "id").select("id", F.concat(said, more).alias("answer"))


def number_of(t: Column) -> Column:
    """The first number of a text, with Japanese multipliers."""
    packed = F.replace(t, F.lit(" "), F.lit(""))
    pattern = r"([0-9][0-9,]*(?:\.[0-9]+)?)(億|万|千)?(?:([0-9][0-9,]*(?:\.[0-9]+)?)(億|万|千))?"
    part = lambda i: F.regexp_extract(packed, pattern, i)
    value = lambda i: F.replace(part(i), F.lit(","), F.lit("")).try_cast("double")
    times = lambda i: F.when(part(i) == "億", 1e8).when(part(i) == "万", 1e4).when(part(i) == "千", 1e3).otherwise(1.0)
    second = F.when((part(2) != "") & (part(4) != ""), value(3) * times(4)).otherwise(0.0)
    return F.when(packed.rlike("[0-9]"), value(1) * times(2) + second)


def consolidated(rows: DataFrame, found: DataFrame, least: float = 0.7) -> DataFrame:
    """seq of sentences to drop: they state the same subject and relation as an earlier one in nearly the same terms, and are the worse."""
    firsts = found.groupBy("subject_key", "relation").agg(F.min("seq").alias("first"))
    bags = rows.select("seq", "quality", F.array_distinct(T.terms("text")).alias("t"))
    pairs = found.join(firsts, ["subject_key", "relation"]).where("seq > first").select("seq", "first").distinct()
    pairs = pairs.join(bags, "seq").join(bags.select(F.col("seq").alias("first"), F.col("quality").alias("q1"), F.col("t").alias("t1")), "first")
    alike = F.size(F.array_intersect("t", "t1")) / F.size(F.array_union("t", "t1"))
    return pairs.where(alike >= least).select(F.when(F.round("q1", 9) < F.round("quality", 9), F.col("first")).otherwise(F.col("seq")).alias("seq")).distinct()
