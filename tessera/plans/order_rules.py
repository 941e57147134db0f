"""Rules for the order table: one of every kind of rule that the engine knows.

Two-tier thresholds, a median rule, a rule over two columns, a range, a text match,
flags, segment rules with a floor, texts per stage with a default, and notes.
"""

from tessera.operators.rules import ActionRule, RuleSet, SegmentRule

#: Keys of the three kinds of segments (best, costly, rest), their names and colours.
ORDER_SEGMENTS = ("steady", "costly", "strained")
ORDER_SEGMENT_LABELS = {"steady": "Steady orders", "costly": "Costly orders", "strained": "Strained orders"}
ORDER_SEGMENT_COLORS = {"steady": "#1b7f4b", "costly": "#b8860b", "strained": "#a33b20", "unknown": "#808080"}

ORDER_RULES = RuleSet(
    actions=[
        ActionRule("tiers", ("acct_bal",), (
            ("<", 0.0, "Customer owes {v}: hold new credit until paid."),
            ("<", 2500.0, "Customer balance {v} is under 2500: ask for part payment."),
        )),
        ActionRule("tiers", ("disc_sum",), (
            ("<", "median", "Discounts add up to {v}, less than the usual {m}: offer a rebate on the next order."),
        ), 3),
        ActionRule("tiers", ("price_max",), (
            (">=", 90000.0, "One line costs {v}: ship it separately and insure it."),
            (">=", 70000.0, "One line costs {v}: check the unit price."),
        )),
        ActionRule("tiers", ("tax_sum",), (
            (">=", 0.5, "Tax rates add up to {v}: have the tax codes checked."),
        )),
        ActionRule("pair", ("price_sum", "total_price"), (
            ((400000.0, 400000.0), "Lines and order total come to {a}/{b}: get a manager to sign."),
            ((300000.0, 300000.0), "Lines and order total come to {a}/{b}: confirm by phone."),
        )),
        ActionRule("range", ("part_size_max",), ((5.0, 45.0), "Largest part has size {v}, not between 5 and 45: book special freight."), 0),
        ActionRule("contains", ("priority",), ("urgent", "Customer is in a hurry: pick this order first.")),
        ActionRule("flag", ("has_return",), ("Something came back: inspect the batch.",)),
        ActionRule("flag", ("has_open",), ("Lines are still open: chase the warehouse.",)),
        ActionRule("flag", ("neg_balance",), ("Account is overdrawn: copy the credit desk.",)),
    ],
    default_ok_class="empty",
    default_ok_text="Nothing to do for this order yet.",
    default_other_text="No rule fired: handle the order by its stage.",
    segment_rules=[
        SegmentRule("acct_bal", "<", "Ask customers of this segment for a deposit of 2500.", floor=2500.0),
        SegmentRule("disc_sum", "<", "Plan a discount campaign."),
        SegmentRule("tax_sum", ">", "Train staff on tax codes."),
        SegmentRule("total_price", ">", "Set a lower limit for unsigned orders."),
        SegmentRule("price_max", ">", "Audit the dearest lines every quarter."),
    ],
    segment_default="No measure is due for this segment.",
    stage_texts={
        "empty": {"meaning": ["No line has been booked."], "guidance": ["Ask whether the order stands."],
                  "next_steps": ["Look again in a week."]},
        "bulk": {"meaning": ["Nine lines or more."], "guidance": ["Ship together."],
                 "next_steps": ["Reserve a lorry."]},
        "small": {"meaning": ["Fewer than 30 units."], "guidance": ["Send by parcel."],
                  "next_steps": ["Print the label."]},
        "mid": {"meaning": ["30 to 79 units."], "guidance": ["Send by pallet."],
                "next_steps": ["Order a pickup."]},
        "large": {"meaning": ["80 units or more."], "guidance": ["Count the stock first."],
                  "next_steps": ["Reserve the stock."]},
        "*": {"meaning": ["Stage not known."], "guidance": ["Route by hand."],
              "next_steps": ["Report the stage."]},
    },
    combined_notes={
        ("empty", "steady"): "Empty order, sound customers.",
        ("empty", "costly"): "Empty order among dear ones.",
        ("empty", "strained"): "Empty order, weak customers.",
        ("small", "steady"): "Parcel for a sound customer.",
        ("small", "costly"): "Parcel among dear orders.",
        ("small", "strained"): "Parcel for a weak customer: prepay.",
        ("large", "steady"): "Big order, sound customers: go ahead.",
        ("large", "costly"): "Big and dear: sign off today.",
        ("large", "strained"): "Big order, weak customers: prepay.",
        ("bulk", "*"): "Freight decides here.",
        ("mid", "*"): "Pallet freight, any segment.",
        ("*", "*"): "Look at stage and segment separately.",
    },
    segment_summaries={
        "steady": "Good balances, ordinary totals.",
        "costly": "Dear orders.",
        "strained": "Low balances and few discounts.",
    },
    segment_summary_default="A group without a summary.",
)
