"""offerlake: Spark-native analytics over product offers extracted from documents."""
