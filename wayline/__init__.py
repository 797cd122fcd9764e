"""Analytics over catalogues of media, tracks and messages that share one timeline and one map."""
