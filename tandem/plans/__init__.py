"""Multi-step jobs: prompt building, retrieval, inference, scoring."""
