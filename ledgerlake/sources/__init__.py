"""Where rows come from: typed tables, JSON payloads, texts, and the store of held payloads."""
