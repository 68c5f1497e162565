"""Model fits on the given tables; SQL cannot say them, so they are compared with brute force in the tests."""

from pyspark.sql import functions as F

from surveyframe.functions.basics import uniform
from surveyframe.operators import models as ML
from surveyframe.operators import splits as SP
from surveyframe.operators.scale import salted_join
from surveyframe.plans.metrics import scored
from surveyframe.plans.registry import query
from surveyframe.plans.spectra import binned

FEATURES = ["s", "s2", "n_chars"]


def rows(t):
    x = scored(t).withColumn("n_chars", F.col("n_chars").cast("double")).withColumn("train", uniform("star", 5) < 0.7)
    w = SP.class_weights(x, "y")
    return x.join(F.broadcast(w), "y")


@query("table_baselines", "M05")
def _(t):
    x = rows(t)
    out = None
    for kind in ("logistic", "forest", "boosted"):
        m = ML.baseline(kind, FEATURES, "y", "weight").fit(x.filter("train"))
        one = m.transform(x.filter("not train")).agg(F.lit(kind).alias("model"), F.avg((F.col("prediction") == F.col("y")).cast("int")).alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out


@query("permutation_importance", "M06")
def _(t):
    x = rows(t)
    m = ML.baseline("logistic", FEATURES, "y", "weight").fit(x.filter("train"))
    return ML.permutation_importance(m, x.filter("not train"), FEATURES, "y", "doc_id")


@query("calibration_choice", "M07")
def _(t):
    x = scored(t)
    g = SP.assign_folds(SP.group_table(x.withColumn("label", F.col("y").cast("string")), "star", "label"), "star", 3, 9)
    return ML.cross_validated_calibration(salted_join(x, g.select("star", "fold"), ["star"]), "fold", "y", "s2", 3)


@query("leave_one_out_platt", "M08")
def _(t):
    return ML.leave_one_out_platt(scored(t), "doc_id", "y", "s2")


@query("leave_one_out_log_score", "M08")
def _(t):
    return ML.log_score_against_base(ML.leave_one_out_platt(scored(t), "doc_id", "y", "s2"))


@query("visit_information", "M19")
def _(t):
    b = binned(t).filter("unc > 0").withColumn("signal", F.exp(-F.pow((F.col("bin") - 12) / 3.0, 2))).withColumn("slope", F.col("bin") / 24.0)
    return ML.visit_information(b, "user_id", "bin", "signal", "unc", ["slope"], 0.1, 2.0)


@query("amplitude_profile", "M19")
def _(t):
    """Correlated noise of every user's binned series about its mean, with the interval where the likelihood falls by a half."""
    b = binned(t).filter("unc > 0").withColumn("spot", F.col("bin") / 24.0 - 0.5).withColumn("x", F.ln(F.col("bin") + 1.0))
    level = b.groupBy("user_id").agg((F.sum(F.col("depth") / F.pow("unc", 2)) / F.sum(1 / F.pow("unc", 2))).alias("level"))
    return ML.amplitude_profile(salted_join(b, level, ["user_id"]), "user_id", "x", "depth", "unc", "level", {"spot": 0.3}, 50.0, 0.3, "spot")


@query("offset_free_information", "M19", """with e as (select user_id, sin(value) as s, 1 / power(0.1::double + 0.01::double * value, 2) as w from events), g as (select user_id, sum(w) as w, sum(w * s) as ws, sum(w * s * s) as q from e group by 1) select user_id, round(q - ws * ws / w, 5) as information from g""")
def _(t):
    e = t.events.select("user_id", F.sin("value").alias("s"), (1 / F.pow(0.1 + 0.01 * F.col("value"), 2)).alias("w"))
    return ML.joint_information(e, ["user_id"], "s", "w").withColumn("information", F.round("information", 5))


@query("regularised_nuisance_fit", "M19")
def _(t):
    e = t.events.select("user_id", F.col("value").alias("y"), (0.1 + 0.01 * F.col("value")).alias("e"), F.lit(1.0).alias("one"), F.sin("event_id").alias("wave"))
    return ML.regularised_fit(e, ["user_id"], "y", "e", ["one", "wave"], [10.0, 1.0]).select("user_id", F.col("coefficients")[0].alias("offset"), F.col("coefficients")[1].alias("wave"), "chi2")


@query("reconstruction_error", "M20")
def _(t):
    return ML.leave_group_out_reconstruction(t.embeddings, "vec_id", "label", "embedding")


@query("cluster_agreement", "M20")
def _(t):
    return ML.cluster_agreement(ML.two_means(t.embeddings, "vec_id", "embedding"), "cluster", F.col("label") < 5)


@query("held_out_language_scores", "M24")
def _(t):
    x = rows(t).join(t.documents.select("doc_id", "lang"), "doc_id").withColumn("donor", F.when(uniform("doc_id", 3) < 0.1, "en").otherwise(F.col("lang")))
    return ML.held_out_scores(x, "lang", "lang", "donor", FEATURES, "y").groupBy("held").agg(F.count("*").alias("rows"), F.avg("score").alias("mean_score"))
