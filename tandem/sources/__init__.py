"""Reading and writing data sets, and facts about stored tables."""
