"""DataFrame in, DataFrame out. No operator collects rows, and none hints a broadcast of data
whose size is not bounded by a constant or by a clamped parameter."""
