"""Analytics on ordered logs of fixed-size draws, as Spark plans."""
