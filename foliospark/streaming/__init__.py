"""The inbox as a stream that is drained and ends."""
