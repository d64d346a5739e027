"""Variant spellings of people and organisations: canonical rewritings, exploded and equi-joined, scored by their rarity.

Each name is rewritten by rules: titles and possessives go, reordered parts are put in order, nicknames become the given
names they stand for, given names become initials, legal forms are dropped, shortened words are written out, descriptions
become acronyms, words with a typing error become the spelling they are one edit away from. Every rewriting also comes
joined with what else the name states, a middle initial or a city. Names that state a full form offer all its rewritings; every name asks for
its own. A rewriting counts one over the number of identities that offer it, and a name belongs to the identity whose
matching rewritings count most; where two count alike it stays unlinked. Names that nobody offers anything to make identities of
their own rewritings, by the same join and score.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Short forms and the given names they stand for.
NICKNAMES = {
    "alex": "alexander alexandra", "sasha": "alexander alexandra", "ben": "benjamin", "benny": "benjamin", "beth": "elizabeth", "liz": "elizabeth", "lizzy": "elizabeth", "betty": "elizabeth",
    "bill": "william", "will": "william", "willy": "william", "bob": "robert", "rob": "robert", "bobby": "robert", "dan": "daniel", "danny": "daniel", "dani": "daniela",
    "dora": "dorothea theodora", "dot": "dorothea", "dorothy": "dorothea", "thea": "theodora dorothea", "ed": "edward", "ted": "edward theodore", "eddie": "edward", "etta": "henrietta", "hetty": "henrietta",
    "fine": "josefine", "josie": "josefine", "josephine": "josefine", "fran": "francisco", "paco": "francisco", "gabi": "gabriela", "gaby": "gabriela", "guy": "guillaume",
    "hannes": "johannes", "hans": "johannes", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "catherine": "katherine", "len": "leonard", "leo": "leonard", "lenny": "leonard",
    "lotte": "charlotte", "charlie": "charlotte charles", "maggie": "margaret", "peggy": "margaret", "meg": "margaret", "mike": "michael", "mick": "michael", "mila": "ludmila", "nick": "nicholas",
    "nico": "nicholas", "nicky": "nicholas", "sam": "samantha samuel", "seba": "sebastian", "bastian": "sebastian", "tom": "thomas", "tommy": "thomas", "toni": "antonia",
    "uschi": "ursula", "ulla": "ursula", "vicky": "viktoria", "victoria": "viktoria", "jim": "james", "joe": "joseph", "dick": "richard", "rick": "richard", "andy": "andrew", "jimmy": "james", "jamie": "james", "joey": "joseph", "jo": "joseph joanna", "jack": "john", "johnny": "john", "jon": "jonathan", "chris": "christopher christina christian", "kit": "christopher katherine", "tina": "christina martina", "steve": "stephen steven",
    "dave": "david", "davy": "david", "greg": "gregory", "matt": "matthew matthias", "pat": "patrick patricia", "patty": "patricia", "trish": "patricia", "pete": "peter", "phil": "philip", "ray": "raymond", "ron": "ronald", "rich": "richard", "ricky": "richard",
    "stan": "stanley", "stu": "stuart", "tim": "timothy", "vic": "victor", "vince": "vincent", "walt": "walter", "zach": "zachary", "abe": "abraham", "al": "albert alan alfred", "bert": "albert herbert robert", "bernie": "bernard", "cathy": "katherine", "cindy": "cynthia", "deb": "deborah",
    "debbie": "deborah", "don": "donald", "doug": "douglas", "fred": "frederick alfred", "gene": "eugene", "gerry": "gerald", "hank": "henry", "harry": "henry harold", "jenny": "jennifer", "jerry": "jerome gerald", "ken": "kenneth", "larry": "lawrence", "lou": "louis louise",
    "mandy": "amanda", "marge": "margaret", "max": "maximilian maxwell", "mel": "melanie melvin", "millie": "mildred", "nat": "nathaniel natalie", "ned": "edward", "nell": "eleanor helen", "nora": "eleanor", "peg": "margaret", "penny": "penelope", "polly": "mary", "molly": "mary", "sally": "sarah", "sandy": "alexander sandra",
    "sue": "susan", "susie": "susan", "terry": "terence theresa", "toby": "tobias", "tess": "theresa", "wes": "wesley", "basti": "sebastian", "flo": "florian florence", "fritz": "friedrich", "heinz": "heinrich", "heini": "heinrich", "jupp": "josef", "sepp": "josef", "kalle": "karl", "klaus": "nikolaus", "lena": "helena magdalena",
    "lisa": "elisabeth", "liesel": "elisabeth", "micha": "michael", "moni": "monika", "rudi": "rudolf", "steffi": "stefanie", "susi": "susanne", "uli": "ulrich ulrike", "willi": "wilhelm", "wolfi": "wolfgang", "manu": "manuel manuela", "lola": "dolores", "pepe": "jose", "paqui": "francisca", "chema": "jose", "nacho": "ignacio",
    "quique": "enrique", "concha": "concepcion", "beppe": "giuseppe", "gigi": "luigi", "pippo": "filippo", "nando": "fernando", "ze": "jose", "chico": "francisco", "wim": "willem", "kees": "cornelis", "piet": "pieter", "jaap": "jacob", "bea": "beatrice", "gus": "august", "tony": "anton anthony antonio",
}
#: Titles before a name.
TITLES = frozenset("dr prof mr mrs ms miss sir dipl ing mag herr frau mme mlle sr sra dott".split())
#: Words of organisation names in short, other or inflected form, and the word that they stand for.
WORDS = {
    "fdn": "foundation", "found": "foundation", "inst": "institute", "institut": "institute", "dept": "department", "dep": "department", "univ": "university", "uni": "university",
    "intl": "international", "int": "international", "inc": "incorporated", "ltd": "limited", "co": "company", "corp": "corporation", "med": "medical", "ctr": "center", "centre": "center", "cntr": "center",
    "sw": "software", "log": "logistics", "logistik": "logistics", "pub": "publishing", "publ": "publishing", "tech": "technology", "res": "research", "dev": "development", "assn": "association", "assoc": "association",
    "bros": "brothers", "mfg": "manufacturing", "gov": "government", "natl": "national", "lab": "laboratory", "labs": "laboratory", "hosp": "hospital", "acad": "academy",
}
#: Legal forms, which a name may have or not; and words that carry no meaning of their own.
LEGAL = frozenset("gmbh limited incorporated company corporation llc plc ag kg sa srl bv nv ohg ev".split())
SMALL = frozenset("of for and the de la du und fur für of".split())

WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Lower case without accents, control marks and possessive endings, blanks made single."""
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return re.sub(r"\s+", " ", re.sub(r"['’]s\b", "", text, flags=re.I)).strip(" ,;:.\t\r\n") if text else ""


def person(label: str) -> tuple[str, list[str], str | None, str | None]:
    """(surname, given names it may stand for, initial, middle initial); no given names where only initials are stated."""
    text = plain(label)
    if "," in text:
        last, _, rest = text.partition(",")
        given = WORD.findall(rest)
        words = WORD.findall(last)
    else:
        words = [w for w in WORD.findall(text)]
        while len(words) > 1 and words[0].lower() in TITLES:
            words = words[1:]
        if len(words) >= 2 and len(words[0]) > 1 and words[0].isupper() and not all(w.isupper() for w in words):
            words, given = words[:1], words[1:]
        else:
            given, words = words[:-1], words[-1:]
    given = [g.lower() for g in given if g.lower() not in TITLES]
    surname = " ".join(w.lower() for w in words if w.lower() not in TITLES)
    middle = next((g[0] for g in given[1:]), None)
    if not given:
        return surname, [], None, None
    first = given[0]
    if len(first) == 1:
        return surname, [], first, middle
    return surname, NICKNAMES.get(first, first).split(), first[0], middle


def organisation(label: str) -> tuple[str, str | None, list[str], list[str]]:
    """(first word, description or none where it is an acronym, rewritings asked for, rewritings offered)."""
    text = plain(label).replace("&", " and ")
    parts = [p.strip() for p in text.split(",") if p.strip()]
    tokens = WORD.findall((" ".join(parts[1:] + parts[:1]) if len(parts) == 2 and parts[1].lower().rstrip(".") not in LEGAL | set(WORDS) else text).lower())
    if tokens[:1] == ["the"]:
        tokens = tokens[1:]
    if not tokens:
        return "", None, [], []
    name, rest = tokens[0], tokens[1:]
    if len(rest) >= 3 and rest[:3] == ["r", "and", "d"]:
        rest = ["research", "and", "development", *rest[3:]]
    written = WORD.findall(text)
    capitals = len(written) == 2 and written[1].isupper() and len(written[1]) > 1 and not written[0].isupper()
    if len(rest) == 1 and rest[0] not in WORDS and rest[0] not in LEGAL and (capitals or len(rest[0]) <= 5):
        return name, None, [f"A:{rest[0]}"], []
    words = [WORDS.get(w, w) for w in rest]
    content = [w for w in words if w not in SMALL]
    core = [w for w in content if w not in LEGAL] or content
    described = " ".join(core)
    offers = {f"D:{described}", "A:" + "".join(w[0] for w in content), "A:" + "".join(w[0] for w in words)}
    return name, described, [f"D:{described}"], sorted(offers)


PARSED = "id string, kind string, name string, primary string, asks array<string>, offers array<string>, middle string, city string"


def parse(nodes: DataFrame, id_col: str = "id", label_col: str = "label", type_col: str = "node_type", properties_col: str | None = "properties_json") -> DataFrame:
    """One row per node of type PERSON or ORGANIZATION with its rewritings. Null ids and names without a letter give no row."""
    city = F.get_json_object(F.col(properties_col), "$.city") if properties_col else F.lit(None).cast("string")
    source = nodes.where(F.col(type_col).isin("PERSON", "ORGANIZATION") & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(type_col).alias("kind"), F.col(label_col).cast("string").alias("label"), city.alias("city")
    )

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for i, kind, label, town in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == "PERSON":
                    name, given, initial, middle = person(label)
                    primary = given[0] if len(given) == 1 else None
                    asks = [f"G:{g}" for g in given] or ([f"I:{initial}"] if initial else ["N:"])
                    offers = [f"G:{primary}", f"I:{initial}"] if primary else []
                else:
                    name, primary, asks, offers = organisation(label)
                    middle = None
                if name:
                    rows.append((i, kind, name, primary, asks, offers, middle, town))
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.string()] * 4 + [pa.list_(pa.string())] * 2 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "kind", "name", "primary", "asks", "offers", "middle", "city"])

    return source.mapInArrow(batches, PARSED)


def respelled(parsed: DataFrame) -> DataFrame:
    """(kind, name, hub): the spelling that a rarer one, one edit away, is taken for. Names without such a one are absent.

    Found through an equi-join of the names' single deletions. A spelling met more than twice, or of fewer than five letters, gives way only
    to one at least four times as frequent.
    """
    count = parsed.groupBy("kind", "name").agg(F.count("*").alias("support"))
    cuts = F.concat(F.array("name"), F.expr("transform(sequence(1, length(name)), i -> concat(substring(name, 1, i - 1), substring(name, i + 1)))"))
    forms = count.where(F.length("name") >= 2).select("kind", "name", "support", F.explode(F.array_distinct(cuts)).alias("form"))
    x, y = forms.alias("x"), forms.alias("y")
    swapped = (F.length("x.name") == F.length("y.name")) & (F.array_sort(F.split("x.name", "")) == F.array_sort(F.split("y.name", "")))
    better = (F.col("y.support") > F.col("x.support")) | ((F.col("y.support") == F.col("x.support")) & (F.col("y.name") < F.col("x.name")))
    rare = (F.col("x.support") <= 2) & (F.length("x.name") >= 5) | (F.col("x.support") * 4 <= F.col("y.support"))
    near = x.join(y, (F.col("x.kind") == F.col("y.kind")) & (F.col("x.form") == F.col("y.form"))).where((F.col("x.name") != F.col("y.name")) & better & rare & ((F.levenshtein("x.name", "y.name") <= 1) | swapped))
    best = near.groupBy(F.col("x.kind").alias("kind"), F.col("x.name").alias("name")).agg(F.max(F.struct(F.col("y.support").alias("s"), F.col("y.name").alias("hub"))).alias("b"))
    once = best.select("kind", "name", F.col("b.hub").alias("hub"))
    again = once.select(F.col("kind").alias("k2"), F.col("name").alias("n2"), F.col("hub").alias("h2"))
    return once.join(again, (F.col("kind") == F.col("k2")) & (F.col("hub") == F.col("n2")), "left").select("kind", "name", F.coalesce("h2", "hub").alias("hub"))


def _joined(forms: str, middle: str, city: str) -> F.Column:
    """Every form alone, and joined with the middle initial and the city where they are stated."""

    def more(column: str, mark: str) -> F.Column:
        with_it = F.transform(forms, lambda f: F.concat(f, F.lit(mark), F.col(column)))
        return F.when(F.col(column).isNotNull(), with_it).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(F.col(forms), more(middle, "|M:"), more(city, "|C:")))


def attribute(known: DataFrame, identities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, identity) of the names that one identity's rewritings fit best, ids of all names that any fit).

    known: id, kind, name, asks, middle, city; identities: identity, kind, name, offers, i_middle, i_city. Names whose middle
    initials differ don't fit.
    """
    offered = identities.select("identity", "kind", "name", "i_middle", F.explode(_joined("offers", "i_middle", "i_city")).alias("form"))
    rarity = offered.groupBy("kind", "name", "form").agg(F.count("*").alias("shared"))
    offered = offered.join(rarity, ["kind", "name", "form"])
    asked = known.select("id", "kind", "name", "middle", F.explode(_joined("asks", "middle", "city")).alias("form"))
    fits = asked.join(offered, ["kind", "name", "form"]).where(F.col("middle").isNull() | F.col("i_middle").isNull() | (F.col("middle") == F.col("i_middle")))
    scored = fits.groupBy("id", "identity").agg(F.round(F.sum(1 / F.col("shared")), 9).alias("score"))
    # the best of a name, and whether another one counts alike
    top = scored.groupBy("id").agg(F.max("score").alias("top"))
    chosen = scored.join(top, "id").where("score >= top").groupBy("id").agg(F.count("*").alias("n"), F.min("identity").alias("identity"))
    chosen = cut_lineage(chosen)
    return chosen.where("n = 1").select("id", "identity"), chosen.select("id")


def _identities(known: DataFrame) -> DataFrame:
    """The identities that names with a full form state."""
    full = known.where("primary IS NOT NULL").groupBy("kind", "name", "primary").agg(F.max("middle").alias("i_middle"), F.mode("city").alias("i_city"), F.array_distinct(F.flatten(F.collect_set("offers"))).alias("offers"))
    return full.withColumn("identity", F.concat_ws("|", "kind", "name", "primary"))


def _known(parsed: DataFrame, hubs: DataFrame) -> DataFrame:
    return parsed.join(hubs, ["kind", "name"], "left").withColumn("name", F.coalesce("hub", "name")).drop("hub")


def _all(nodes: DataFrame, mentions: DataFrame | None, **columns) -> tuple[DataFrame, DataFrame | None]:
    parsed = cut_lineage(parse(nodes, **columns).dropDuplicates(["id"]))
    hubs = cut_lineage(respelled(parsed))
    known = cut_lineage(_known(parsed, hubs))
    identities = cut_lineage(_identities(known))
    found, fitting = attribute(known, identities)
    lone = cut_lineage(known.join(fitting, "id", "left_anti"))
    # names that nobody offers anything to offer what they ask for themselves, apart by middle initial
    own = lone.select("kind", "name", F.slice("asks", 1, 1).alias("offers"), F.col("middle").alias("i_middle"), F.lit(None).cast("string").alias("i_city")).distinct()
    stated = own.groupBy("kind", "name", "offers").agg(F.max("i_middle").alias("any"))
    own = own.join(stated, ["kind", "name", "offers"]).where(F.col("i_middle").isNotNull() | F.col("any").isNull()).drop("any")
    own = own.withColumn("identity", F.concat_ws("|", "kind", "name", F.col("offers")[0], "i_middle"))
    rest, _ = attribute(lone.withColumn("asks", F.slice("asks", 1, 1)), own)
    nodes_found = found.unionByName(rest)
    if mentions is None:
        return nodes_found, None
    words = _known(cut_lineage(parse(mentions, id_col="id", label_col="text", type_col="label", properties_col=None)), hubs)
    return nodes_found, attribute(words, identities.select("identity", "kind", "name", "offers", "i_middle", "i_city"))[0]


def identify(nodes: DataFrame, **columns) -> DataFrame:
    """(id, identity) of every node that could be attributed; nodes of one identity mean the same person or organisation.

    Repeated rows of a node count once. An empty table gives an empty result.
    """
    return _all(nodes, None, **columns)[0]


def identify_mentions(nodes: DataFrame, mentions: DataFrame) -> DataFrame:
    """(entity_id, label, identity) of the mentions (id, text, normalized, label) that mean one identity of the nodes.

    A mention's text is rewritten like a node's label; where it fits no single identity, the node that its normalised form names
    counts. Rows repeated under one id count once; each spelling is rewritten once however often it is mentioned.
    """
    spelt = mentions.where("text IS NOT NULL AND label IN ('PERSON', 'ORGANIZATION')").select("text", "label").distinct()
    spelt = cut_lineage(spelt.withColumn("id", F.sha1(F.concat_ws("|", "label", "text"))))
    by_node, by_text = _all(nodes, spelt)
    named = nodes.select("id", F.col("label").alias("normalized"), F.col("node_type").alias("label")).join(by_node, "id").select("normalized", "label", F.col("identity").alias("of_node")).dropDuplicates(["normalized", "label"])
    read = spelt.join(by_text, "id").select("text", "label", F.col("identity").alias("of_text"))
    rows = mentions.select(F.col("id").alias("entity_id"), "text", "normalized", "label").where("entity_id IS NOT NULL")
    both = rows.join(read, ["text", "label"], "left").join(named, ["normalized", "label"], "left").withColumn("identity", F.coalesce("of_text", "of_node"))
    return both.where("identity IS NOT NULL").groupBy("entity_id", "label").agg(F.min("identity").alias("identity"))


def linked(nodes: DataFrame, part: int = 4_000, **columns) -> DataFrame:
    """All pairs (id_a, id_b), id_a < id_b, of nodes with one identity. The nodes of an identity are cut into parts of about
    `part`, and each pair of parts is joined in its own task."""
    found = cut_lineage(identify(nodes, **columns))
    parts = found.groupBy("identity").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where("parts > 0")
    cut = found.join(parts, "identity").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    a = cut.select("identity", F.col("own").alias("i"), every.alias("j"), F.col("id").alias("id_a"))
    b = cut.select("identity", F.col("own").alias("j"), every.alias("i"), F.col("id").alias("id_b"))
    return a.join(b, ["identity", "i", "j"]).where("id_a < id_b").select("id_a", "id_b")
