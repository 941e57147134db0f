"""tessera: Spark-native tabular risk analytics.

Profiling, exact stratified sampling, encoding, tree models, imbalance-aware
metrics, segmentation, relational tree SHAP and rule-based recommendations,
all expressed as DataFrame -> DataFrame functions over Spark.
"""

__version__ = "0.1.0"
