"""riskloom: Spark-native credit-risk feature and scoring engine."""
