"""Rule configuration for the reference's own 31-column patient schema.

Fixed values: thresholds and sentences of the reference's decision rules, stated
as configuration for the generic engine in ``operators/rules.py``.
"""

from tessera.operators.rules import ActionRule, RuleSet, SegmentRule

# Patient action rules (thresholds and sentences), in output order.
PATIENT_ACTIONS = [
    ActionRule("tiers", ("physical_activity_minutes_per_week",), (
        ("<", 90.0, "Physical activity is currently {v} minutes per week, which is well below the usual 150-minute target; increasing movement is one of the clearest priorities."),
        ("<", 150.0, "Physical activity is {v} minutes per week, so increasing it toward 150 minutes per week would better support glucose control and weight management."),
    ), 0),
    ActionRule("tiers", ("diet_score",), (
        ("<", "median", "The diet score is {v}, which is below the training median of {m}; diet quality should improve, especially around refined carbohydrates, sugary drinks, and fiber intake."),
    ), 2),
    ActionRule("tiers", ("bmi",), (
        (">=", 30.0, "BMI is {v}, which suggests obesity-range weight burden; structured weight-management support could have a meaningful effect on glucose and cardiovascular risk."),
        (">=", 25.0, "BMI is {v}, which suggests excess weight may be contributing to risk; even modest weight reduction could help improve metabolic control."),
    ), 2),
    ActionRule("tiers", ("glucose_fasting",), (
        (">=", 126.0, "Fasting glucose is {v}, which is already in a clearly raised range and should be reviewed clinically rather than monitored casually."),
        (">=", 100.0, "Fasting glucose is {v}, which is above the usual healthy range and supports closer follow-up of glucose markers."),
    ), 2),
    ActionRule("tiers", ("glucose_postprandial",), (
        (">=", 200.0, "Post-meal glucose is {v}, which is markedly raised and strengthens the case for prompt clinical review."),
        (">=", 140.0, "Post-meal glucose is {v}, which suggests meal-related glucose control may need attention."),
    ), 2),
    ActionRule("tiers", ("hba1c",), (
        (">=", 6.5, "HbA1c is {v}, which is in a diabetic-range marker and supports prompt clinical review."),
        (">=", 5.7, "HbA1c is {v}, which is above the usual healthy range and suggests glucose control should be followed more closely."),
    ), 2),
    ActionRule("pair", ("systolic_bp", "diastolic_bp"), (
        ((140.0, 90.0), "Blood pressure is {a}/{b}, which is clearly raised and should be managed alongside diabetes risk because cardiovascular risk compounds quickly."),
        ((130.0, 80.0), "Blood pressure is {a}/{b}, which is above ideal and worth addressing as part of the overall metabolic-risk plan."),
    ), 0),
    ActionRule("tiers", ("ldl_cholesterol",), (
        (">=", 130.0, "LDL cholesterol is {v}, so lipid management should be part of the follow-up plan, especially if diabetes risk is already elevated."),
    ), 2),
    ActionRule("tiers", ("triglycerides",), (
        (">=", 150.0, "Triglycerides are {v}, which suggests additional metabolic strain and strengthens the case for nutrition-focused follow-up."),
    ), 2),
    ActionRule("range", ("sleep_hours_per_day",), ((7.0, 9.0), "Sleep duration is {v} hours per day, so sleep pattern may be adding metabolic strain; aiming for a steadier 7 to 9 hours would be more supportive."), 1),
    ActionRule("tiers", ("screen_time_hours_per_day",), (
        (">", 6.0, "Screen time is {v} hours per day, which suggests prolonged sedentary time; adding regular movement breaks through the day would help."),
    ), 1),
    ActionRule("tiers", ("alcohol_consumption_per_week",), (
        (">", 14.0, "Alcohol intake is {v} drinks per week, so reducing intake may help with glucose control, blood pressure, and weight management."),
    ), 1),
    ActionRule("contains", ("smoking_status",), ("current", "Current smoking was reported, so smoking cessation support should be part of the plan because it increases cardiovascular and metabolic risk.")),
    ActionRule("flag", ("family_history_diabetes",), ("Family history of diabetes was reported, which increases baseline risk and supports more proactive monitoring.",)),
    ActionRule("flag", ("hypertension_history",), ("A history of hypertension was reported, so blood pressure control should remain part of the diabetes prevention or management plan.",)),
    ActionRule("flag", ("cardiovascular_history",), ("A history of cardiovascular disease was reported, which raises the urgency of follow-up because diabetes and cardiovascular risk reinforce each other.",)),
]

# Segment recommendation rules and default.
PATIENT_SEGMENT_RULES = [
    SegmentRule("physical_activity_minutes_per_week", "<", "Increase weekly physical activity toward at least 150 minutes.", floor=150.0),
    SegmentRule("diet_score", "<", "Improve diet quality with more fiber-rich foods and fewer refined sugars."),
    SegmentRule("bmi", ">", "Prioritize weight-management support and routine lifestyle follow-up."),
    SegmentRule("glucose_fasting", ">", "Monitor fasting glucose trends closely and escalate clinical review when needed."),
    SegmentRule("hba1c", ">", "Schedule regular HbA1c follow-up and reinforce medication adherence if prescribed."),
]

# Segment keys (best, risk, other), display names and colours.
PATIENT_SEGMENTS = ("healthy", "elevated_glucose", "unhealthy")
PATIENT_SEGMENT_LABELS = {
    "healthy": "Healthy Patient Cluster",
    "elevated_glucose": "Elevated Glucose Patient Cluster",
    "unhealthy": "Unhealthy Patient Cluster",
}
PATIENT_SEGMENT_COLORS = {
    "healthy": "#2f8f68",
    "elevated_glucose": "#d7a255",
    "unhealthy": "#c9774c",
    "unknown": "#91a196",
}

# Stage texts, notes and summaries of the 31-column schema.
PATIENT_RULES = RuleSet(
    actions=PATIENT_ACTIONS,
    default_ok_class="No Diabetes",
    default_ok_text="The values entered do not show one strong patient-specific risk flag, so the main priority is maintaining healthy habits and staying consistent with routine screening.",
    default_other_text="The values entered do not point to one dominant lifestyle issue, so the safest approach is to follow the stage-specific guidance and keep monitoring consistent.",
    segment_rules=PATIENT_SEGMENT_RULES,
    segment_default="Current cluster profile is comparatively stable. Maintain the existing activity and diet pattern.",
    stage_texts={
        "No Diabetes": {
            "meaning": ["The current inputs are closer to a non-diabetes pattern than to the diabetes stages in this model.",
                        "This is the lowest-risk result in the tool, but it is not a guarantee that diabetes cannot develop later."],
            "guidance": ["Treat this as a prevention result, not as permission to stop monitoring risk factors.",
                         "The main priorities are maintaining physical activity, a stable weight, good sleep, and a diet that does not gradually push glucose higher over time.",
                         "If family history, blood pressure, or glucose markers are borderline, keep follow-up proactive even though the stage result is the lowest-risk one."],
            "next_steps": ["Maintain the current healthy pattern and continue routine diabetes screening during regular primary care visits.",
                           "If there is family history, raised blood pressure, or increasing glucose markers, ask for repeat fasting glucose or HbA1c testing rather than waiting for symptoms.",
                           "Use this result as a prevention window: keep activity up, protect sleep, and avoid gradual weight gain over time."]},
        "Pre-Diabetes": {
            "meaning": ["The current inputs suggest glucose regulation may be starting to drift outside the healthy range.",
                        "This is a warning stage where early lifestyle change and clinical follow-up can still slow or prevent progression."],
            "guidance": ["This is the stage where lifestyle change has the best chance to delay or prevent progression to diabetes.",
                         "The most useful priorities are regular weekly activity, lower intake of refined carbohydrates and sugary drinks, weight reduction if needed, and steady follow-up of glucose markers.",
                         "Avoid a passive wait-and-see approach; this stage is best handled with a specific prevention plan."],
            "next_steps": ["Arrange a primary care follow-up to confirm the risk pattern with formal lab review and repeat HbA1c or fasting glucose testing.",
                           "Start a structured prevention plan now, especially regular activity, carbohydrate quality improvement, and weight reduction if needed.",
                           "Ask whether referral to a dietitian, diabetes prevention programme, or more frequent monitoring is appropriate."]},
        "Type 2": {
            "meaning": ["The current inputs are more consistent with a Type 2 diabetes pattern than the other stages in this model.",
                        "This usually reflects sustained glucose-control strain and should be treated as a prompt for clinical confirmation rather than a standalone diagnosis."],
            "guidance": ["Type 2 guidance should combine medical review with lifestyle change rather than relying on lifestyle alone.",
                         "The practical priorities are glucose control, nutrition quality, regular activity, weight management if needed, and control of blood pressure and cholesterol risk.",
                         "Long-term complication prevention matters here, so eye, kidney, foot, and cardiovascular follow-up should be part of the plan."],
            "next_steps": ["Arrange prompt clinical review to confirm the diagnosis, review glucose and HbA1c results, and decide whether medication is needed.",
                           "Discuss a full diabetes care plan, including blood pressure, cholesterol, kidney monitoring, eye screening, foot checks, and self-monitoring guidance.",
                           "Begin lifestyle changes immediately while the medical plan is being confirmed, especially around activity, nutrition, and weight management."]},
        "Type 1": {
            "meaning": ["The current inputs are most consistent with a Type 1 diabetes pattern in this model.",
                        "A new or unexpected Type 1 pattern should be treated more urgently than a routine watch-and-wait result because Type 1 diabetes can worsen quickly."],
            "guidance": ["Type 1 diabetes is not mainly managed through lifestyle alone; insulin education and close clinical support are central.",
                         "The practical priorities are glucose monitoring, hypoglycaemia safety, sick-day planning, and clear action steps for rising glucose or ketones.",
                         "Lifestyle habits still matter, but they support treatment rather than replacing it."],
            "next_steps": ["If this is a new or unexpected result, seek urgent medical review because Type 1 diabetes needs rapid clinical assessment and management.",
                           "If Type 1 has already been diagnosed, the next steps are close coordination with a diabetes specialist team, insulin education, glucose monitoring, and sick-day planning.",
                           "Ask for guidance on ketone monitoring, hypoglycaemia management, and when to seek urgent care if symptoms worsen."]},
        "Gestational": {
            "meaning": ["The current inputs are most consistent with a gestational diabetes pattern in this model.",
                        "Gestational diabetes needs pregnancy-specific review because both maternal and fetal health can be affected if glucose remains uncontrolled."],
            "guidance": ["Gestational diabetes guidance needs to be pregnancy-specific rather than treated like standard Type 2 advice.",
                         "The practical priorities are glucose monitoring, meal planning that fits pregnancy care goals, and close coordination with the obstetric team.",
                         "Follow-up should continue after delivery as well, because future diabetes risk can remain higher even when pregnancy ends."],
            "next_steps": ["Contact the obstetric and diabetes care team promptly because gestational diabetes needs close pregnancy-specific follow-up.",
                           "Review blood glucose monitoring targets, meal planning, and whether medication or insulin is needed during pregnancy.",
                           "Plan postpartum glucose follow-up as well, because diabetes risk can remain elevated after delivery."]},
        "*": {"meaning": ["The predicted stage shows which diabetes pattern the model considers the best fit for the current inputs.",
                          "This result should be reviewed alongside formal tests, symptoms, and clinical history rather than used on its own."],
              "guidance": ["Use the predicted stage as a guide to urgency and follow-up rather than as a final diagnosis.",
                           "The safest approach is structured clinical review plus steady improvement in lifestyle risk factors."],
              "next_steps": ["Review the result with a clinician and use it alongside formal testing, symptoms, and medical history rather than as a standalone diagnosis.",
                             "Focus on structured follow-up, glucose monitoring, and steady lifestyle improvement while the clinical picture is clarified."]},
    },
    combined_notes={
        ("No Diabetes", "healthy"): "Both the stage result and the segment suggest a relatively stable overall profile, so the main goal is to maintain healthy habits and keep screening routine.",
        ("No Diabetes", "elevated_glucose"): "The stage result is not diabetes, but the segment still suggests some glucose pressure compared with the healthiest group, so prevention should stay active.",
        ("No Diabetes", "unhealthy"): "The stage result is less concerning than diabetes, but the segment still suggests lifestyle or metabolic strain that can raise future risk.",
        ("Pre-Diabetes", "healthy"): "This combination suggests glucose may be rising even though the broader lifestyle profile is comparatively stable, so early action still matters.",
        ("Pre-Diabetes", "elevated_glucose"): "Both the stage result and the segment point toward glucose burden, so this is a strong prevention-and-follow-up signal.",
        ("Pre-Diabetes", "unhealthy"): "This combination suggests both rising glucose risk and a broader lifestyle or metabolic burden, so prevention should be structured rather than casual.",
        ("Type 2", "healthy"): "The diabetes-stage result is more concerning than the broader segment profile, which can happen when glucose markers are carrying much of the signal.",
        ("Type 2", "elevated_glucose"): "Both the stage result and the segment point strongly toward poor glucose control, so medical review should not be delayed.",
        ("Type 2", "unhealthy"): "Both the stage result and the segment suggest a broader metabolic burden rather than one isolated issue, so follow-up should be comprehensive.",
        ("Type 1", "*"): "For a Type 1 pattern, the predicted stage matters more clinically than the segment label. Use the segment as lifestyle context, but let urgency and follow-up be driven by the stage result.",
        ("Gestational", "*"): "For a gestational diabetes pattern, the predicted stage matters more clinically than the segment label. Use the segment as background context, but let pregnancy-specific care drive the plan.",
        ("*", "*"): "The stage prediction estimates which diabetes pattern fits best, while the segment shows what broader patient profile the person resembles. Together they help focus follow-up.",
    },
    personal_none="Patient-specific priorities use the values entered into the form.",
    personal_all="Patient-specific priorities use all {n} entered inputs from the form.",
    personal_some="Patient-specific priorities use the {n} values entered into the form. Blank fields were excluded from this personalised section.",
)
