"""DR3/DR4/DR8 on literal rows of the reference schema: thresholds at, below and
above each boundary; blanks; unparseable numbers; 'CURRENT smoker'."""

from pyspark.sql import functions as F

from tessera.operators import rules as R
from tessera.plans.patient_rules import PATIENT_RULES
from tessera.plans.spec import PATIENT_SPEC

COLS = list(PATIENT_SPEC.numeric) + list(PATIENT_SPEC.binary) + ["smoking_status"]
MED = {"diet_score": 6.0}


def frame(spark, rows):
    data = [tuple(r.get(c) for c in COLS) + (r.get("predicted", "Type 2"),) for r in rows]
    schema = ", ".join(f"`{c}` string" for c in COLS) + ", predicted string"
    df = spark.createDataFrame(data, schema)
    miss = F.filter(F.array(*[F.when(F.col(c).isNull() | (F.trim(F.col(c)) == ""), F.lit(c)) for c in COLS]),
                    lambda x: x.isNotNull())
    return df.withColumn("missing_columns", miss)


def actions(spark, rows):
    out = R.patient_actions(frame(spark, rows), PATIENT_RULES, MED).select("actions").collect()
    return [r["actions"] for r in out]


def test_activity_tiers(spark):
    a = actions(spark, [{"physical_activity_minutes_per_week": "89"}, {"physical_activity_minutes_per_week": "90"},
                        {"physical_activity_minutes_per_week": "150"}])
    assert a[0][0].startswith("Physical activity is currently 89 minutes")
    assert a[1][0].startswith("Physical activity is 90 minutes per week, so increasing")
    assert a[2] == [PATIENT_RULES.default_other_text]


def test_hba1c_and_bmi_boundaries(spark):
    a = actions(spark, [{"hba1c": "6.5", "bmi": "25"}, {"hba1c": "5.69", "bmi": "24.99"}])
    assert a[0] == ["BMI is 25.00, which suggests excess weight may be contributing to risk; even modest weight reduction could help improve metabolic control.",
                    "HbA1c is 6.50, which is in a diabetic-range marker and supports prompt clinical review."]
    assert a[1] == [PATIENT_RULES.default_other_text]


def test_blood_pressure_missing_side(spark):
    a = actions(spark, [{"systolic_bp": "141"}, {"diastolic_bp": "80"}])
    assert a[0][0].startswith("Blood pressure is 141/?, which is clearly raised")
    assert a[1][0].startswith("Blood pressure is ?/80, which is above ideal")


def test_text_flag_unparseable_and_default(spark):
    a = actions(spark, [{"smoking_status": "CURRENT smoker", "family_history_diabetes": "1"},
                        {"bmi": "abc", "predicted": "No Diabetes"}])
    assert a[0][0].startswith("Current smoking was reported") and a[0][1].startswith("Family history")
    assert a[1] == [PATIENT_RULES.default_ok_text]


def test_diet_median_and_sleep_range(spark):
    a = actions(spark, [{"diet_score": "5.5", "sleep_hours_per_day": "6.5"}])
    assert a[0][0] == ("The diet score is 5.50, which is below the training median of 6.00; diet quality should improve, "
                       "especially around refined carbohydrates, sugary drinks, and fiber intake.")
    assert a[0][1].startswith("Sleep duration is 6.5 hours per day")


def test_personalisation_note(spark):
    df = frame(spark, [{"bmi": "30"}])
    n = len(PATIENT_SPEC.features)
    out = R.personalisation_note(df, PATIENT_RULES, n).first()["personalisation_note"]
    missing = len(COLS) - 1
    assert out.startswith(f"Patient-specific priorities use the {n - missing} values")


def test_stage_texts_and_combined_notes(spark):
    df = spark.createDataFrame([("Type 2", "elevated_glucose"), ("Type 1", "healthy"), ("Unknown", None),
                                ("No Diabetes", None)], "predicted string, segment_key string")
    out = R.combined_note(R.stage_texts(df, PATIENT_RULES), PATIENT_RULES).collect()
    by = {r["predicted"]: r for r in out}
    assert by["Type 2"]["combined_note"].startswith("Both the stage result and the segment point strongly")
    assert by["Type 1"]["combined_note"].startswith("For a Type 1 pattern")
    assert by["Unknown"]["combined_note"].startswith("The stage prediction estimates")
    assert by["No Diabetes"]["combined_note"].startswith("The stage prediction estimates")
    assert len(by["Type 2"]["guidance"]) == 3 and len(by["Unknown"]["meaning"]) == 2
