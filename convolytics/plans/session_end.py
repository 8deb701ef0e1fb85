"""What happens when sessions end: status, scores, ledger, terms and plans for the next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolytics.operators import effects as fx
from convolytics.operators import messages as ms
from convolytics.operators import scores as sc
from convolytics.operators import sessions as se
from convolytics.operators import vocab as vo
from convolytics.operators.backends import Backend


def end_sessions(
    messages: DataFrame,
    transcripts: DataFrame,
    old_usages: DataFrame,
    acts: DataFrame,
    users: DataFrame,
    as_of: Column,
    n: int = 16,
    max_usg: int = 4,
    scores: DataFrame | None = None,
    ledger_out: str | None = None,
    backend: Backend | None = None,
    memory: DataFrame | None = None,
    translator=None,
) -> dict[str, DataFrame]:
    """The results of one run over all transcripts that ended.

    ``transcripts`` with status, ``usages`` with the new uses, ``plans`` with the
    vocabulary of each learner's next session, ``next_transcripts`` for those plans,
    and ``scores`` when there are any. With ``ledger_out`` the uses are written to
    that new folder first, and the plans are made from there instead of from the messages.
    With a ``backend`` there are ``grades``, ``skills``, ``topics`` and, given a translation
    ``memory`` and a ``translator``, ``summaries`` of the finalised transcripts, and
    ``effect_rejects`` with the name of the effect. ``transcripts`` then needs ``bcp47``.
    """
    final = ms.finalize(transcripts, messages)
    ended = final.where(F.col("status") == "final").select(*ms.KEY)
    said = ms.filter_roles(messages, ["usr"]).join(ended, ms.KEY, "left_semi")
    uses = vo.usages_of(vo.extract_terms(said))
    columns = [*vo.USE, "used_correctly", "when"]
    every = vo.distinct_uses(old_usages.select(*columns).unionByName(uses.select(*columns)))
    if ledger_out is not None:
        # Never over an older version: the old uses may be read from it.
        every.write.mode("errorifexists").parquet(ledger_out)
        every = messages.sparkSession.read.schema(every.schema).parquet(ledger_out)
    chosen = vo.select_vocabulary(vo.summarize_usages(every), n, max_usg, as_of)
    # At most n terms per learner and language are left to collect.
    lists = chosen.groupBy("uid", "bcp47").agg(
        F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_v")
    )
    vocab = lists.select("uid", "bcp47", F.transform("_v", lambda x: x["term"]).alias("vocab"))
    plans = se.plans_from_acts(acts, users, as_of).join(vocab, ["uid", "bcp47"], "left")
    out = {
        "transcripts": final,
        "usages": every,
        "plans": plans,
        "next_transcripts": se.transcripts_from_plans(plans, as_of),
    }
    if scores is not None:
        out["scores"] = sc.transcript_scores(scores)
    if backend is not None:
        out |= _effects(messages, final, backend, memory, translator)
    return out


def _effects(messages, final, backend, memory, translator) -> dict[str, DataFrame]:
    """What models say about the finalised transcripts."""
    heads = final.where(F.col("status") == "final")
    talks = messages.join(heads.select(*ms.KEY), ms.KEY, "left_semi")
    assessed, bad = fx.assess_skills(talks, heads, backend)
    split, odd = fx.split_skills(assessed, backend)
    done = {
        "grades": fx.grade_transcripts(talks, backend, None),
        "skills": (assessed.join(split, ms.KEY, "left"), bad.unionByName(odd)),
        "topics": fx.extract_topics(talks, heads, backend),
    }
    if translator is not None:
        done["summaries"] = fx.summarize(talks, backend, memory, translator)
    out = {name: good for name, (good, _) in done.items()}
    rejects = [r.withColumn("effect", F.lit(name)) for name, (_, r) in done.items()]
    return out | {"effect_rejects": reduce(DataFrame.unionByName, rejects)}
