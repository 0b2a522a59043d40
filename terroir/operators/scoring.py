"""Judging undecided candidates with an outside scorer: case building, keys, cache, decision and evaluation.

The scorer itself is injected. Everything around it is relational: candidates are rows, a case is a group, and only cases
whose key is not in the cache are asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Default parameters.
SCORE_MIN, MARGIN_MIN, CONFIDENCE_MIN, POOL_MAX = 1.5, 0.5, 0.5, 8


def top_candidates(pool: DataFrame, case: Sequence[str], distance: Column, tie: Sequence[str], k: int = POOL_MAX) -> DataFrame:
    """The k nearest candidates of each case with ``pos`` from 0: placed ones by distance, then those without, ties by ``tie``."""
    w = Window.partitionBy(*case).orderBy(distance.asc_nulls_last(), *tie)
    return pool.withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < k)


def reference(pos: Column) -> Column:
    return F.concat(F.lit("c"), pos.cast("string"))


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def pool_fingerprint(pool: DataFrame, case: Sequence[str], ident: str = "numero_dpe", address: str = "adresse_brut") -> DataFrame:
    """case, empreinte: one hash of the (id, address) pairs of a case, whatever their order."""
    pairs = F.sort_array(F.collect_list(F.struct(_text(ident).alias("i"), _text(address).alias("a"))))
    return pool.groupBy(*case).agg(F.sha2(F.to_json(pairs), 256).alias("empreinte"))


def cache_key(*parts: Column) -> Column:
    """A stable key of a case: its sale, address, pool fingerprint, model and question version."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(p.cast("string"), F.lit("∅")).alias(f"p{k}") for k, p in enumerate(parts)])), 256)


def states(pool: DataFrame, case: Sequence[str], lot_address: str = "adresse_brute", address: str = "adresse_brut") -> DataFrame:
    """case, etat: what is asked, as JSON; addresses and references only. Pools are at most k long by ``top_candidates``."""
    item = F.struct("pos", reference(F.col("pos")).alias("ref"), _text(address).alias("adresse"))
    listed = F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x["ref"].alias("ref"), x["adresse"].alias("adresse")))
    return pool.groupBy(*case).agg(F.to_json(F.struct(F.min(_text(lot_address)).alias("mutation"), listed.alias("candidats"))).alias("etat"))


def questions(pool: DataFrame, case: Sequence[str]) -> DataFrame:
    """case, ref, type: a score question per candidate and one guard per case."""
    scored = pool.select(*case, reference(F.col("pos")).alias("ref"), F.lit("score").alias("type"))
    return scored.unionByName(pool.select(*case).distinct().select(*case, F.lit("garde").alias("ref"), F.lit("noul").alias("type")))


def best_candidates(answers: DataFrame, case: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """case, pos, score, marge, confiance of the best answer (first of ties) and other columns of its row; input: case, pos, score, confidence.
    Missing answers count as 0; the margin of a single candidate is its score."""
    score = F.coalesce("score", F.lit(0.0))
    w = Window.partitionBy(*case).orderBy(score.desc(), "pos")
    ranked = answers.select(*case, "pos", score.alias("score"), F.coalesce("confidence", F.lit(0.0)).alias("confiance"), F.row_number().over(w).alias("_r"), F.lead(score).over(w).alias("_next"), *carried)
    return ranked.where(F.col("_r") == 1).select(*case, *carried, "pos", "score", (F.col("score") - F.coalesce("_next", F.lit(0.0))).alias("marge"), "confiance")


#: Fixed value: the state of a case the scorer resolved.
RESOLVED = "resolu_jev"


def decide(best: DataFrame, guard: str = "garde", score_min: float = SCORE_MIN, margin_min: float = MARGIN_MIN, confidence_min: float = CONFIDENCE_MIN, entry: str | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """The best answers with ``motif`` and ``resolu``: thresholds in the order score, margin, confidence; then the guard may cancel.

    entry: column of the state a case came with; it gives ``match_status``, which is that state again unless the case is resolved. carried: columns of the
    chosen candidate that only a resolved case keeps."""
    motif = (
        F.when(F.col("pos").isNull(), "pool_vide").when(F.col("score") < score_min, "score_insuffisant").when(F.col("marge") < margin_min, "marge_insuffisante")
        .when(F.col("confiance") < confidence_min, "confiance_insuffisante").when(F.coalesce(~F.col(guard), F.lit(False)), "garde_noul").otherwise("resolu")
    )
    out = best.withColumn("motif", motif).withColumn("resolu", F.col("motif") == "resolu")
    out = out.withColumns({c: F.when(F.col("resolu"), F.col(c)) for c in carried}) if carried else out
    return out if entry is None else out.withColumn("match_status", F.when(F.col("resolu"), RESOLVED).otherwise(F.col(entry)))


def sample(cases: DataFrame, key: str, k: int) -> DataFrame:
    """The k cases with the smallest keys; all of them if k is not positive."""
    return cases.orderBy(key).limit(k) if k > 0 else cases


def stratified_sample(cases: DataFrame, stratum: str, key: str, k: int) -> DataFrame:
    """The k smallest keys of every stratum."""
    if k <= 0:
        return cases
    return cases.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(key))).where(F.col("_r") <= k).drop("_r")


def unanswered(cases: DataFrame, cache: DataFrame, key: str = "cle") -> DataFrame:
    """Cases whose key is not in the cache."""
    return cases.join(cache.select(key).distinct(), key, "left_anti")


def judge(cases: DataFrame, cache: DataFrame, ask: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None, schema: str, key: str = "cle", size: str | None = None) -> DataFrame:
    """Every case with its verdict and ``source``: cache; demande, what ``ask`` gives for batches of the other cases (schema: key first); sans_reponse, asked
    without an answer; sans_cle, not asked as there is no ``ask``; pool_vide, without candidates and so never asked nor
    looked up (``size`` names the column that counts them). Only the first two have a verdict."""
    full = cases if size is None else cases.where(F.coalesce(size, F.lit(0)) > 0)
    known = full.join(cache, key).withColumn("source", F.lit("cache"))
    open_ = unanswered(full, cache, key)
    if ask is None:
        rest = open_.withColumn("source", F.lit("sans_cle"))
    else:
        asked = open_.mapInPandas(ask, schema).withColumn("source", F.lit("demande"))
        rest = open_.join(asked, key, "left").withColumn("source", F.coalesce("source", F.lit("sans_reponse")))
    out = known.unionByName(rest, allowMissingColumns=True)
    if size is None:
        return out
    return out.unionByName(cases.where(F.coalesce(size, F.lit(0)) <= 0).withColumn("source", F.lit("pool_vide")), allowMissingColumns=True)


def run_totals(judged: DataFrame, tokens: str = "input_tokens", millis: str = "duree_ms") -> DataFrame:
    """One row: cas, appels, servis_par_cache, input_tokens, duree_s; tokens and time are those of the calls made, not of cached verdicts."""
    asked = F.col("source") == "demande"
    total = lambda c: F.coalesce(F.sum(F.when(asked, F.col(c))), F.lit(0))
    return judged.agg(F.count(F.lit(1)).alias("cas"), F.count_if(asked).alias("appels"), F.count_if(F.col("source") == "cache").alias("servis_par_cache"), total(tokens).alias("input_tokens"), (total(millis) / 1000).alias("duree_s"))


def run_counts(judged: DataFrame, status: str = "match_status", reason: str = "motif") -> DataFrame:
    """genre (status or motif), valeur, n of a run."""
    of = lambda genre, c: judged.groupBy(F.col(c).alias("valeur")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(genre).alias("genre"), "valeur", "n")
    return of("status", status).unionByName(of("motif", reason))


def normalize_response(raw: Column) -> Column:
    """Scores of a JSON answer in either of two shapes: a map ref -> {score, confidence}, or {"answers": that map}."""
    shape = "map<string,struct<score:double,confidence:double,noul:boolean>>"
    nested = F.from_json(F.get_json_object(raw, "$.answers"), shape)
    return F.coalesce(nested, F.from_json(raw, shape))


def read_response(raw: Column, expected_model: str | None = None) -> Column:
    """A response as (reponses: ref -> score, confidence, noul; modele; input_tokens). Answers of an unknown type are left out; without usage there are 0
    tokens. A model other than the expected one is an error: its verdict would be kept under a key that names the other."""
    model = F.coalesce(F.get_json_object(raw, "$.model"), F.lit(""))
    answers = F.from_json(F.get_json_object(raw, "$.answers"), "map<string,struct<type:string,score:double,confidence:double,noul:boolean>>")
    kept = F.map_filter(F.coalesce(answers, F.create_map().cast("map<string,struct<type:string,score:double,confidence:double,noul:boolean>>")), lambda _, a: a["type"].isin("score", "noul"))
    plain = F.transform_values(kept, lambda _, a: F.struct(a["score"].alias("score"), a["confidence"].alias("confidence"), a["noul"].alias("noul")))
    out = F.struct(plain.alias("reponses"), model.alias("modele"), F.coalesce(F.get_json_object(raw, "$.usage.input_tokens").try_cast("long"), F.lit(0)).alias("input_tokens"))
    if expected_model is None:
        return out
    return F.when(model == expected_model, out).otherwise(F.raise_error(F.concat(F.lit("answered by model '"), model, F.lit(f"', not by '{expected_model}'"))))


def evaluate(decided: DataFrame, answer: str = "reponse", chosen: str = "numero_dpe") -> DataFrame:
    """Decided cases with correct_top1 and correct_a_seuil."""
    right = F.coalesce(F.col(chosen) == F.col(answer), F.lit(False))
    return decided.withColumns({"correct_top1": right, "correct_a_seuil": right & F.col("resolu")})


def summarize(evaluated: DataFrame, regimes: Sequence[str] = ("isole", "multi")) -> DataFrame:
    """regime, n, exactitude_top1, resolus, exactitude_a_seuil, taux_erreur_residuel (null without resolved cases)."""
    n, r = F.count(F.lit(1)), F.count_if("resolu")
    agg = evaluated.groupBy("regime").agg(n.alias("n"), F.count_if("correct_top1").alias("ok"), r.alias("resolus"), F.count_if("correct_a_seuil").alias("ok_seuil"))
    every = evaluated.sparkSession.createDataFrame([(x,) for x in regimes], "regime string").join(agg, "regime", "left").na.fill(0)
    at = F.when(F.col("resolus") > 0, F.col("ok_seuil") / F.col("resolus"))
    return every.select("regime", "n", F.when(F.col("n") > 0, F.col("ok") / F.col("n")).otherwise(0.0).alias("exactitude_top1"), "resolus", F.coalesce(at, F.lit(0.0)).alias("exactitude_a_seuil"), (1 - at).alias("taux_erreur_residuel"))


def cases(pool: DataFrame, case: Sequence[str], sale: Sequence[str], model: str, version: str, lot_address: str = "adresse_brute") -> DataFrame:
    """case, cle, etat: what is asked of each case and the key its verdict is kept by; pool has ``pos``."""
    lot = pool.groupBy(*case).agg(*[F.min(c).alias(f"_{k}") for k, c in enumerate(sale)], F.min(_text(lot_address)).alias("_adresse"))
    keyed = lot.join(pool_fingerprint(pool, case), list(case)).join(states(pool, case, lot_address), list(case))
    key = cache_key(*[F.col(f"_{k}") for k in range(len(sale))], F.col("_adresse"), F.col("empreinte"), F.lit(model), F.lit(version))
    return keyed.select(*case, key.alias("cle"), "etat")


def incoherent(recorded: DataFrame, relinked: DataFrame, key: str, status: str) -> DataFrame:
    """Rows recorded with a status that linking again does not give: the tables come from different runs."""
    again = relinked.where(F.col("match_status") == status).select(key).distinct()
    return recorded.where(F.col("match_status") == status).join(again, key, "left_anti")
