"""Table configuration: which column plays which role.

The engine is generic; a ``TableSpec`` names the id, target, leakage and feature
columns of one table. Feature order is numeric, binary, ordinal, nominal: it is the
vector slot order used by every model and explanation.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TableSpec:
    id_col: str
    target: str
    leakage: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    binary: tuple[str, ...] = ()
    ordinal: tuple[tuple[str, tuple[str, ...]], ...] = ()
    nominal: tuple[str, ...] = ()
    # profile columns for segmentation: (column, higher_is_healthier)
    profile: tuple[tuple[str, bool], ...] = field(default=())

    @property
    def ordinal_cols(self) -> tuple[str, ...]:
        return tuple(c for c, _ in self.ordinal)

    @property
    def ordinal_levels(self) -> dict[str, tuple[str, ...]]:
        return dict(self.ordinal)

    @property
    def categorical(self) -> tuple[str, ...]:
        return self.binary + self.ordinal_cols + self.nominal

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.binary + self.ordinal_cols + self.nominal

    @property
    def string_cols(self) -> tuple[str, ...]:
        return (self.target,) + self.ordinal_cols + self.nominal


# The ordinal orders of the reference schema.
EDUCATION_LEVELS = ("No formal", "Highschool", "Graduate", "Postgraduate")
INCOME_LEVELS = ("Low", "Lower-Middle", "Middle", "Upper-Middle", "High")

# The reference's own 31-column schema (used with literal rows in tests).
PATIENT_SPEC = TableSpec(
    id_col="row_id",
    target="diabetes_stage",
    leakage=("diagnosed_diabetes", "diabetes_risk_score"),
    numeric=(
        "Age", "alcohol_consumption_per_week", "physical_activity_minutes_per_week",
        "diet_score", "sleep_hours_per_day", "screen_time_hours_per_day", "bmi",
        "waist_to_hip_ratio", "systolic_bp", "diastolic_bp", "heart_rate",
        "cholesterol_total", "hdl_cholesterol", "ldl_cholesterol", "triglycerides",
        "glucose_fasting", "glucose_postprandial", "insulin_level", "hba1c",
    ),
    binary=("family_history_diabetes", "hypertension_history", "cardiovascular_history"),
    ordinal=(("education_level", EDUCATION_LEVELS), ("income_level", INCOME_LEVELS)),
    nominal=("gender", "ethnicity", "employment_status", "smoking_status"),
    profile=(
        ("physical_activity_minutes_per_week", True),
        ("diet_score", True),
        ("bmi", False),
        ("glucose_fasting", False),
        ("hba1c", False),
    ),
)

PRIORITY_LEVELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
BALANCE_BANDS = INCOME_LEVELS

# The driver-table binding (order_profile view, see FIXTURES.md).
ORDER_SPEC = TableSpec(
    id_col="row_id",
    target="stage",
    leakage=("line_count", "qty_sum"),
    numeric=("total_price", "price_sum", "price_max", "disc_sum", "tax_sum",
             "part_size_max", "acct_bal"),
    binary=("has_return", "has_open", "neg_balance"),
    ordinal=(("priority", PRIORITY_LEVELS), ("balance_band", BALANCE_BANDS)),
    nominal=("status", "segment", "region"),
    # activity-like (higher healthier) x2, risk-like (lower healthier) x3
    profile=(
        ("acct_bal", True),
        ("disc_sum", True),
        ("tax_sum", False),
        ("total_price", False),
        ("price_max", False),
    ),
)
