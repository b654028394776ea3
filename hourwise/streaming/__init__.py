"""hourwise.streaming: the daily summary and spike feed over Structured Streaming."""
