"""tablado: Spark-native operators for turning noisy listings into clean, ranked tables."""
