"""Lines that rules are known to hit, for the corpus of the queries and the tests.

Each is (file type, line, ids of the rules it hits); ids of the second type are
those of .vmt and .ttf, .vtf numbers the same patterns differently.
"""

WITNESSES: list[tuple[str, str, list[int]]] = [
    ('lua', 'RunString ("x")', [1]),
    ('lua', 'CompileString("x")', [2]),
    ('lua', 'x=loadstring("x")', [3]),
    ('lua', 'BroadcastLua("x")', [4]),
    ('lua', 'p:SendLua("x")', [5]),
    ('lua', 'pcall( RunString, c)', [6]),
    ('lua', 'pcall(CompileString, c)', [7]),
    ('lua', 'pcall(loadstring, c)', [8]),
    ('lua', 'CompileFile("a")', [9]),
    ('lua', 'http.Fetch("u", function(b RunString', [10]),
    ('lua', 'http.Post("u", function(b RunString', [11]),
    ('lua', 'getfenv(1)', [12]),
    ('lua', 'setfenv(1, t)', [13]),
    ('lua', 'debug.getregistry()', [14]),
    ('lua', 'debug.setlocal(1,1,1)', [15]),
    ('lua', 'debug.setupvalue(f,1,1)', [16]),
    ('lua', 'debug.sethook()', [17]),
    ('lua', '_G["k"] = function', [18]),
    ('lua', '_R = debug.getregistry', [19]),
    ('lua', 'rawset(_G , "a", 1)', [20]),
    ('lua', 'game.ConsoleCommand("x")', [21]),
    ('lua', 'RunConsoleCommand("x")', [22]),
    ('lua', 'p:SetUserGroup("superadmin")', [23]),
    ('lua', 'http.Fetch("u", function(b CompileString', [24]),
    ('lua', 'http.Post("u", function(b CompileString', [25]),
    ('lua', '0x0123456789abcdef', [26]),
    ('lua', '"\\x41\\x42\\x43"', [27]),
    ('lua', '"QUJDQUJDQUJDQUJDQUJDQUJDQUJDQUJDQUJDQUJDQUJDQUJDQUJDQUJDQUJDQUJDQUJDQUJDQUJDQUJD"', [28]),
    ('lua', "file.Write('a.lua'", [29]),
    ('lua', 'file.Delete("a")', [30]),
    ('lua', 'sv_allowcslua 1', [31]),
    ('lua', 'rcon_password', [32]),
    ('lua', 'rcon q', [33]),
    ('lua', 'assert(CompileString', [34]),
    ('lua', 'assert(RunString', [35]),
    ('lua', 'os.execute("x")', [36]),
    ('lua', 'io.popen("x")', [37]),
    ('lua', 'io.open("f", "w")', [38]),
    ('lua', 'package.loadlib("x")', [39]),
    ('lua', 'require("ffi")', [40]),
    ('lua', 'ffi.cdef("x")', [41]),
    ('lua', 'ffi.load("x")', [42]),
    ('lua', 'ffi.C.printf', [43]),
    ('lua', 'coroutine.wrap(function RunString', [44]),
    ('lua', 'timer.Simple(1, function RunString', [45]),
    ('lua', 'timer.Simple(1, function http.Fetch', [46]),
    ('lua', 'hook.Add("a","b", function RunString', [47]),
    ('lua', 'net.Receive("a1B2c3D4e5a1B2c3D4e5a1B2c3D4e5a1B2c3D4e5"', [48]),
    ('lua', 'util.AddNetworkString("a1B2c3D4e5a1B2c3D4e5a1B2c3D4e5a1B2c3D4e5"', [49]),
    ('lua', 'string.char(82,117,110,83,116)', [50]),
    ('lua', 'table.concat({string.char', [51]),
    ('lua', '_G[k]', [52]),
    ('lua', 'for k, v in pairs(debug.getregistry', [53]),
    ('lua', 'concommand.Add("a", function RunString', [54]),
    ('lua', 'concommand.Add("a", function http', [55]),
    ('lua', 'net.Receive("a", function RunString', [56]),
    ('lua', 'net.Receive("a", function CompileString', [57]),
    ('lua', 'util.JSONToTable(RunString', [58]),
    ('lua', 'game.CleanUpMap()', [59]),
    ('lua', 'Entity( 12 ):Remove()', [60]),
    ('lua', 'player.GetAll()[1]:Kick', [61]),
    ('lua', 'player.GetAll()[1]:Ban', [62]),
    ('vmt', '97,98,99,100,101,102,103', [1]),
    ('vmt', '\\x41\\x42\\x43', [2]),
    ('vmt', 'RunString(', [3]),
    ('vmt', 'CompileString (', [4]),
    ('vmt', 'loadstring(', [5]),
    ('vmt', 'http.Fetch(', [6]),
    ('vmt', 'http.Post(', [7]),
    ('vmt', 'debug.getregistry', [8]),
    ('vmt', 'BroadcastLua(', [9]),
    ('vmt', 'SendLua(', [10]),
    ('vmt', 'getfenv(', [11]),
    ('vmt', 'setfenv(', [12]),
    ('vmt', '_G["a', [13]),
    ('lua', 'pcall(RunString ("x"))', [1, 6]),
    ('lua', 'hook.Add("T","x",function(p) http.Fetch("u", function(b) RunString(b) end) end)', [1]),
    ('lua', '  _R = debug.getregistry()  rawset(_G, _G[k])', [14, 19, 20, 52]),
    ('lua', 'timer.Simple(1, function() RunString(string.char(82,117,110,83,116,114)) end)', [1, 50]),
    ('lua', 'local ok = x', []),
    ('vmt', '97,98,99,100,101,102,103 RunString(http.Fetch(', [1, 3, 6]),
    ('vmt', '97,98,99', []),
]
