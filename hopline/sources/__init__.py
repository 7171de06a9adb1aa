"""Sources: Kafka-shaped ingest, results source, message minting and fixture inputs."""
