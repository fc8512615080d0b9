"""Practice-log and speech-corpus analytics as Spark DataFrame operators."""
