"""Evidence attributed to units: rule filters, label propagation, mentions, first-seen dedup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.numbers import lenient_int, locale_decimal
from panelspark.functions.text import contains_all, full_match, mentions_unit, normalize_slug
from panelspark.operators.keyfilter import key_filter, may_hold
from panelspark.operators.keys import first_seen, last_wins, union_of_lists
from panelspark.session import cut_lineage

# Programme rules, action suffixes in order of precedence, labels.
OLD_RULE = ("preven", "prepara", "desastr")
NEW_RULE = ("gest", "riscos", "desastres")
ACTION_SUFFIXES = ("8172", "8865", "00TK", "00T5")
DEFAULT_ACTION = "prevenção/preparação"
ATTRIBUTION = "objeto menciona o município"


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def first_suffix(column: Column, suffixes: Sequence[str], default: str) -> Column:
    label = None
    for suffix in suffixes:
        hit = column.endswith(suffix)
        label = F.when(hit, suffix) if label is None else label.when(hit, suffix)
    return label.otherwise(default)


def program_actions(programs: DataFrame) -> DataFrame:
    """Programmes that pass either rule set, with the action label of each row."""
    name = F.lower(text_or_empty(F.col("NOME_PROGRAMA")))
    action = F.upper(F.trim(text_or_empty(F.col("ACAO_ORCAMENTARIA"))))
    suffix = F.lit(False)
    for code in ACTION_SUFFIXES:
        suffix = suffix | action.endswith(code)
    passes = contains_all(name, OLD_RULE) | (contains_all(name, NEW_RULE) & suffix)
    return (programs.filter(passes & (text_or_empty(F.col("ID_PROGRAMA")) != ""))
            .select(F.col("ID_PROGRAMA").alias("program_id"),
                    first_suffix(action, ACTION_SUFFIXES, DEFAULT_ACTION).alias("action")).distinct())


def attribute_transfers(programs: DataFrame, program_proposals: DataFrame, proposals: DataFrame,
                        agreements: DataFrame, units: DataFrame, seq: str = "seq") -> DataFrame:
    """Agreements per unit whose proposal names the unit.

    ``units`` has code, name and uf.  ``seq`` is the arrival order of proposals and agreements:
    a repeated proposal keeps its last row, a repeated agreement its first qualifying row, and
    the latest agreement breaks ties by the later arrival.  The kept agreements are materialised
    because three aggregates read them.
    """
    # A proposal carries at most one label per suffix plus the default one.
    labels = (program_proposals.select(F.col("ID_PROGRAMA").alias("program_id"),
                                       F.col("ID_PROPOSTA").alias("proposal_id"))
              .filter(text_or_empty(F.col("proposal_id")) != "")
              .join(program_actions(programs), "program_id")
              .groupBy("proposal_id").agg(F.collect_set("action").alias("labels")))
    typed = proposals.select(
        F.col("ID_PROPOSTA").alias("proposal_id"),
        text_or_empty(F.col("COD_MUNIC_IBGE")).alias("code"),
        F.trim(text_or_empty(F.col("OBJETO_PROPOSTA"))).alias("object"),
        lenient_int(F.col("ANO_PROP")).alias("proposal_year"), F.col(seq).alias("__seq"))
    # Proposals of other programmes go before whole texts are compared or moved.
    wanted = typed.filter(full_match(F.col("code"), "[0-9]{7}")).join(labels, "proposal_id", "left_semi")
    chosen = last_wins(wanted, ["proposal_id"], "__seq")
    named = (chosen.drop("__seq").join(labels, "proposal_id").join(units.select("code", "name", "uf"), "code")
             .filter(mentions_unit(F.col("object"), F.col("name"), F.col("uf"))).drop("name", "uf"))
    rows = agreements.select(
        F.col("ID_PROPOSTA").alias("proposal_id"), F.col("NR_CONVENIO").alias("number"),
        lenient_int(F.col("ANO")).alias("own_year"),
        F.trim(text_or_empty(F.col("SIT_CONVENIO"))).alias("status"),
        locale_decimal(F.col("VL_GLOBAL_CONV")).alias("global_value"), F.col(seq).alias("seq"))
    qualified = rows.filter(text_or_empty(F.col("number")) != "").join(named, "proposal_id")
    kept = cut_lineage(first_seen(qualified, ["number"], "seq").withColumn(
        "year", F.when(F.col("own_year") != 0, F.col("own_year")).otherwise(F.col("proposal_year"))))
    # An unknown year (0) restarts the running minimum of the first year, in arrival order.
    restart = kept.filter(F.col("year") == 0).groupBy("code").agg(F.max("seq").alias("__zero"))
    after = F.coalesce(F.col("seq") > F.col("__zero"), F.lit(True))
    per_unit = kept.join(restart, "code", "left").groupBy("code").agg(
        F.count("*").alias("agreements"),
        F.coalesce(F.min(F.when(after, F.col("year"))), F.lit(0)).alias("first_year"),
        F.max("year").alias("last_year"),
        F.max_by(F.struct("number", "year", "status", "object",
                          F.col("global_value").alias("globalValue")),
                 F.struct("year", "seq")).alias("latest"))
    actions = union_of_lists(kept.select("code", F.col("labels").alias("actions")), ["code"], "actions")
    return per_unit.join(actions, "code", "left").withColumn("attribution", F.lit(ATTRIBUTION))


def word_runs(tokens: Column, length: Column) -> Column:
    """Distinct runs of ``length`` words, as arrays; null when there are fewer words."""
    starts = F.sequence(F.lit(1), F.size(tokens) - length + 1)
    return F.when(F.size(tokens) >= length, F.array_distinct(F.transform(
        starts, lambda i: F.slice(tokens, i, length))))


def probe_key(size: Column, probe: Column) -> Column:
    """Join key of a run of ``size`` words, or of ``-size`` letters inside a word."""
    return F.xxhash64(size.cast("int"), probe)


def phrase_probes(slugs: DataFrame, probe_words: int, probe_letters: int) -> DataFrame:
    """One probe per distinct phrase: ``__phrase``, ``__size``, ``__key`` and the first word ``__first`` of a run.

    A text that holds a phrase also holds, as whole words, every word of the phrase except perhaps
    the first and the last.  The probe is the run of up to ``probe_words`` of these inner words that
    the fewest other phrases contain, so phrases with a common passage do not all meet the same
    texts.  A phrase of one or two words has no inner word; its longest word lies inside some word
    of the text, so its probe is that word's first ``probe_letters`` letters.
    """
    words = F.split("__phrase", " ")
    distinct = slugs.select("__phrase").distinct()
    runs = (distinct.filter(F.size(words) > 2)
            .select("__phrase", F.slice(words, F.lit(2), F.size(words) - 2).alias("__words"))
            .withColumn("__size", F.least(F.size("__words"), F.lit(probe_words)))
            .select("__phrase", "__size", F.explode(word_runs(F.col("__words"), F.col("__size"))).alias("__run"))
            .select("__phrase", "__size", probe_key(F.col("__size"), F.col("__run")).alias("__key"),
                    F.get("__run", 0).alias("__first")))
    shared = runs.groupBy("__key").agg(F.count("*").alias("__n"))
    long = (runs.join(shared, "__key").groupBy("__phrase")
            .agg(F.min(F.struct("__n", "__size", "__key", "__first")).alias("__probe"))
            .select("__phrase", "__probe.__size", "__probe.__key", "__probe.__first"))
    longest = F.when((F.size(words) > 1) & (F.length(words[1]) > F.length(words[0])), words[1]).otherwise(words[0])
    letters = F.substring(longest, 1, probe_letters)
    size = -F.length(letters)
    short = distinct.filter(F.size(words) <= 2).select(
        "__phrase", size.alias("__size"), probe_key(size, letters).alias("__key"), F.lit(None).cast("string").alias("__first"))
    return long.unionByName(short)


def probe_hits(tokens: Column, probes: DataFrame) -> Column:
    """Places of a text that may hold a phrase: distinct (``__key``, ``__window``), the window in words.

    Two filters of fixed size, of the runs' first words and of all keys, decide while the text is
    read, so only words that pass leave their row.  A window reaches as far as the longest phrase.
    """
    first_words = key_filter(probes.filter("__size > 0").select(F.xxhash64("__first").alias("key")), "key")
    keys = key_filter(probes, "__key")
    # At most ``probe_words`` and ``probe_letters`` values.
    known = probes.agg(F.collect_set(F.when(F.col("__size") > 0, F.col("__size"))).alias("runs"),
                       F.collect_set(F.when(F.col("__size") < 0, -F.col("__size"))).alias("letters"),
                       F.max(F.size(F.split("__phrase", " "))).alias("reach")).first()
    run_sizes, letter_sizes = (F.array(*map(F.lit, sorted(sizes))).cast("array<int>")
                               for sizes in (known.runs, known.letters))
    reach = F.lit(known.reach or 0)
    places = F.sequence(F.lit(1), F.size(tokens))

    def window(place, width):
        start = F.greatest(F.lit(1), place - width)
        return F.array_join(F.slice(tokens, start, place + width - start + 1), " ")

    def kept(found, place, width):
        return F.transform(F.filter(found, lambda key: may_hold(keys, key)), lambda key: F.struct(
            key.alias("__key"), window(place, width).alias("__window")))

    def run_keys(place):
        return kept(F.transform(run_sizes, lambda n: probe_key(n, F.slice(tokens, place, n))), place, reach)

    def letter_keys(place):
        word = F.get(tokens, place - 1)
        pieces = F.transform(F.filter(letter_sizes, lambda n: n <= F.length(word)), lambda n: F.transform(
            F.sequence(F.lit(1), F.length(word) - n + 1), lambda at: probe_key(-n, F.substring(word, at, n))))
        return kept(F.flatten(pieces), place, F.lit(1))

    found = []
    if known.runs:
        starts = F.filter(places, lambda i: may_hold(first_words, F.xxhash64(F.get(tokens, i - 1))))
        found.append(F.flatten(F.transform(starts, run_keys)))
    if known.letters:
        found.append(F.flatten(F.transform(places, letter_keys)))
    nothing = F.array().cast("array<struct<__key:bigint,__window:string>>")
    return F.array_distinct(F.concat(*found)) if found else nothing


def mention_join(texts: DataFrame, text_id: str, text: str, phrases: DataFrame, phrase_id: str,
                 phrase: str, probe_words: int = 8, probe_letters: int = 6) -> DataFrame:
    """Pairs (text, phrase) where the normalised text holds the normalised phrase as a substring.

    Each phrase has one probe (``phrase_probes``).  Texts are read and folded once; the places that
    pass the probes' filters (``probe_hits``) go on with the words around them, never whole texts,
    meet the phrases of their key, and a substring test decides.  Equal phrases are looked up once.
    Null and empty phrases match nothing; a pair of ids is returned once per row of ``phrases``,
    however often the text holds the phrase or its id is repeated.
    """
    slugs = phrases.select(phrase_id, normalize_slug(F.col(phrase)).alias("__phrase")).filter("__phrase <> ''")
    # Read by the filters and the join.
    probes = cut_lineage(phrase_probes(slugs, probe_words, probe_letters))
    tokens = texts.select(text_id, F.split(normalize_slug(F.col(text)), " ").alias("__tokens"))
    hits = tokens.select(text_id, F.explode(probe_hits(F.col("__tokens"), probes)).alias("__hit"))
    found = (hits.select(text_id, "__hit.*").join(probes.select("__key", "__phrase"), "__key")
             .filter(F.col("__window").contains(F.col("__phrase"))).select(text_id, "__phrase").distinct())
    return found.join(slugs, "__phrase").select(text_id, phrase_id)
